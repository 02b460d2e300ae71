"""Small helpers the operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words as every contract here defines them: runs of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall
_LOWER = {c: c + 32 for c in range(65, 91)}

#: Bytes of text a Python task holds as Python objects at a time.
SLICE_BYTES = 1 << 21


def lower_ascii(text: str) -> str:
    """A-Z to a-z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [text or "" for text in batch.column(column).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc32_of(value: Column) -> Column:
    """Unsigned CRC-32 of a value as UTF-8 text; of nothing for null."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")))


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` with further fields."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in fields:
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return schema


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
