"""Row-expanding extraction: one source file in, its top-level callables out."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from callshelf.functions.text import unix_newlines
from callshelf.operators.syntax import definitions
from callshelf.schemas import DEFINITIONS

_ROWS_PER_BATCH = 2_000
_UNPARSABLE = (SyntaxError, ValueError, RecursionError, MemoryError)


def _require_utf8(row: dict) -> None:
    """An escape such as ``"\\ud800"`` makes text no table can hold: a file error."""
    loose = [row["docstring"], row["returns"], *row["parts"], *row["decorators"]]
    "".join(filter(None, loose)).encode("utf-8")


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(DEFINITIONS)
    warnings.simplefilter("ignore", SyntaxWarning)
    rows: list[dict] = []
    for batch in batches:
        names = ("path", "content", "read_error", "arrival", "twin")
        for path, content, read_error, arrival, twin in zip(*map(batch.column, names)):
            path = path.as_py()
            place = {"path": path, "arrival": arrival.as_py(), "twin": twin.as_py()}
            found, error = [], read_error.as_py()
            if error is None:
                try:
                    found = [{**place, **row} for row in definitions(content.as_py() or "")]
                    for row in found:
                        _require_utf8(row)
                except _UNPARSABLE as problem:
                    found, error = [], f"Syntax error in {path}: {problem}"
            rows.append({**place, "error": error})
            rows.extend(found)
            if len(rows) >= _ROWS_PER_BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def extract_definitions(sources: DataFrame) -> DataFrame:
    """Parse every file of ``sources(path, content[, read_error, arrival])`` in one narrow job.

    No shuffle: a task parses the files of its own input split. Size the splits with
    ``spark.sql.files.maxPartitionBytes`` (parsing dominates, so small ones pay off).
    """
    read_error = F.col("read_error") if "read_error" in sources.columns else F.lit(None)
    arrival = F.col("arrival") if "arrival" in sources.columns else F.lit(None)
    files = sources.select(
        "path",
        unix_newlines(F.col("content")).alias("content"),
        read_error.cast("string").alias("read_error"),
        arrival.cast("string").alias("arrival"),
        F.xxhash64("content").alias("twin"),
    )
    return files.mapInArrow(_parse, DEFINITIONS)


def extract_callables(sources: DataFrame) -> DataFrame:
    """Callable rows plus one row per file (only ``path``, and ``error`` if it failed)."""
    keyword, parts = F.col("keyword"), F.col("parts")
    kind = (
        F.when(keyword == "class", "class")
        .when(keyword == "async def", "coroutine")
        .when(F.col("has_yield"), "generator")
        .when(keyword == "def", "function")
    )
    brackets = F.when((keyword == "class") & (F.size(parts) == 0), "").otherwise(
        F.concat(F.lit("("), F.array_join(parts, ", "), F.lit(")"))
    )
    returns = F.coalesce(F.concat(F.lit(" -> "), "returns"), F.lit(""))
    signature = F.concat(keyword, F.lit(" "), "name", brackets, returns, F.lit(":"))
    return extract_definitions(sources).select(
        "path",
        "name",
        kind.alias("type"),
        signature.alias("signature"),
        "docstring",
        "source_code",
        "line_number",
        (keyword == "async def").alias("is_async"),
        "decorators",
        "error",
        "arrival",
        "twin",
    )


def callables_only(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("name").isNotNull()).drop("error", "arrival", "twin")


def parse_errors(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("error").isNotNull()).select("path", "error")
