"""Source files in folders: listing and reading.

Spark's own file sources hide names that start with ``_`` or ``.``, and with them every
``__init__.py``. So folders are listed by a small worker, one level per job, with the
subfolders of each level spread over all tasks again; everything decided about an entry
is a native expression. The folders must be mounted on every executor.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callshelf.functions.patterns import ExcludeRules
from callshelf.functions.paths import relative_path
from callshelf.session import parallelism, scratch, stage

_LISTING = "root string, folder string, name string, is_folder boolean, target string"
_LISTING_ARROW = pa.schema(
    [
        ("root", pa.string()),
        ("folder", pa.string()),
        ("name", pa.string()),
        ("is_folder", pa.bool_()),
        ("target", pa.string()),
    ]
)
_CHUNK_ROWS = 10_000
_CHUNK_BYTES = 32 << 20


def _list_folder(root: str, folder: str, links_one_step: bool) -> Iterator[tuple]:
    """Entries of one folder. ``target`` is what a link to a file stands for.

    A recursive listing takes a link's own target, a flat one the file it ends at.
    Anything unreadable is left out.
    """
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                try:
                    if entry.is_symlink():
                        target = (
                            os.readlink(entry.path)
                            if links_one_step
                            else os.path.realpath(entry.path)
                        )
                        seen = os.path.exists(target) if links_one_step else entry.is_file()
                        if seen:
                            yield root, folder, entry.name, False, target
                    elif entry.is_file() or entry.is_dir():
                        yield root, folder, entry.name, entry.is_dir(), None
                except OSError:
                    continue
    except OSError:
        return


def _lister(links_one_step: bool):
    def list_folders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(_LISTING_ARROW)
            rows.clear()
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _LISTING_ARROW)]
            return pa.record_batch(arrays, schema=_LISTING_ARROW)

        for batch in batches:
            for root, folder in zip(*(batch.column(n).to_pylist() for n in ("root", "folder"))):
                if folder is None:
                    root = folder = os.path.realpath(root)
                for row in _list_folder(root, folder, links_one_step):
                    rows.append(row)
                    if len(rows) >= _CHUNK_ROWS:
                        yield flush()
        yield flush()

    return list_folders


def scan_sources(
    spark: SparkSession,
    roots: str | Sequence[str],
    *,
    recursive: bool = False,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Paths of all ``.py`` files below ``roots``, absolute and distinct: ``DF(path)``.

    Excluded folders are not entered. A root that is missing or no folder gives nothing.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    rules = ExcludeRules(exclude)
    schema = "root string, folder string"
    frontier = spark.createDataFrame([(r, None) for r in roots], schema)
    out = scratch(spark, "listing")
    full = F.concat(F.rtrim("folder", F.lit("/")), F.lit("/"), "name")

    depth = 0
    while True:
        listed = frontier.repartition(parallelism(spark)).mapInArrow(
            _lister(recursive), _LISTING
        )
        path = F.coalesce("target", full)
        inside = path.startswith(F.concat(F.rtrim("root", F.lit("/")), F.lit("/")))
        wanted = (F.col("is_folder") if recursive else F.lit(False)) | F.col("name").rlike(
            r"(?s)[^/]\.py\z"
        )
        # a pattern that hits "." hides the whole tree when folders are entered
        hidden = rules.matches(F.lit(".")) if recursive else F.lit(False)
        kept = (
            listed.where(wanted & inside & ~hidden)
            .where(~rules.matches(relative_path(path, F.col("root"))))
            .select("root", path.alias("path"), "is_folder")
        )
        kept.write.parquet(f"{out}/depth={depth}")
        level = spark.read.schema(kept.schema).parquet(f"{out}/depth={depth}")
        frontier = level.where("is_folder").select("root", F.col("path").alias("folder"))
        depth += 1
        if not recursive or frontier.isEmpty():
            break
    listing = spark.read.schema(kept.schema).parquet(out)
    return listing.where(~F.col("is_folder")).select("path").distinct()


def exclude_paths(
    df: DataFrame,
    patterns: Sequence[str] = (),
    *,
    path: str = "path",
    root: str | None = None,
    defaults: bool = True,
) -> DataFrame:
    """Drop excluded paths of a table; the same rules as for a scan of ``root``."""
    relative = relative_path(F.col(path), root) if root else F.col(path)
    return df.where(~ExcludeRules(patterns, defaults=defaults).excludes(relative))


def _read_files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("data", pa.binary()), ("problem", pa.string())])
    rows: list[dict] = []
    size = 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                with open(path, "rb") as file:
                    data = file.read()
                rows.append({"path": path, "data": data})
                size += len(data)
            except OSError as error:
                rows.append({"path": path, "problem": str(error)})
            if size >= _CHUNK_BYTES or len(rows) >= _CHUNK_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_sources(paths: DataFrame, *, files_per_task: int = 1_000) -> DataFrame:
    """``DF(path, content, read_error)``: strict UTF-8, one error row for a bad file.

    Paths are few bytes and contents are many, so tasks are sized by number of files.
    """
    cores = paths.sparkSession.sparkContext.defaultParallelism
    listed = stage(paths.select("path"), "paths")  # counted and read: listed once
    tasks = max(cores, ceil(listed.count() / files_per_task))
    read = listed.repartition(tasks).mapInArrow(
        _read_files, "path string, data binary, problem string"
    )
    text = F.try_validate_utf8(F.col("data").cast("string"))
    undecodable = F.when(
        F.col("data").isNotNull() & text.isNull(), F.concat(F.lit("Not UTF-8 text: "), "path")
    )
    return read.select(
        "path", text.alias("content"), F.coalesce("problem", undecodable).alias("read_error")
    )
