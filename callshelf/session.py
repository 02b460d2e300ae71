"""Session set-up and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(app: str = "callshelf", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # parsing dominates the cost of a split of source text
        "spark.sql.files.maxPartitionBytes": "32m",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one ``spark.checkpoint.dir`` names.

    A local session without the setting gets a temporary folder; a cluster session
    without it is refused, because a machine-local folder would lose data there.
    """
    named = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    # "local-cluster[...]" has executors with folders of their own
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"Set {_CHECKPOINT_DIR} to a folder all executors share")
    spark.conf.set(_CHECKPOINT_DIR, tempfile.mkdtemp(prefix="callshelf-"))
    return spark.conf.get(_CHECKPOINT_DIR)


def parallelism(spark: SparkSession) -> int:
    """Tasks that keep all cores busy and are not larger than other shuffles' tasks."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, shuffle)


def spread(scan: DataFrame) -> DataFrame:
    """Spread the rows of a plain scan that has fewer splits than there are cores.

    A large table has enough splits and stays where it is: no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared folder."""
    return f"{shared_folder(spark)}/callshelf/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back. Cuts lineage, survives lost executors, prunes columns."""
    return stage_at(df, scratch(df.sparkSession, name))


def stage_at(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Steps that run inside hand at most so many rows at a time to Python and back.

    Wide rows (texts, sets) would else fill the memory beside the heap, ten thousand at a
    time in each task. Rows are the same; the session's own setting comes back.
    """
    before = spark.conf.get(_BATCH_ROWS)
    # 0 or less: no limit
    spark.conf.set(_BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Steps that run inside drop their shuffle files when they end, not when the driver
    happens to collect its garbage. The session's own setting comes back."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def release(spark: SparkSession, folder: str) -> None:
    """Give back the space of a staged table: nothing is written over it."""
    spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(folder)
