"""Incremental ingest: new rows of a table of sources are folded into the catalog."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callshelf.plans.ingest import ingest
from callshelf.schemas import SOURCES
from callshelf.sources.store import CatalogStore


def read_source_stream(
    spark: SparkSession, folder: str, max_files_per_batch: int | None = None
) -> DataFrame:
    """Files that arrive in a parquet table of sources. (A raw tree is no stream source:
    file sources hide names that start with ``_``.)

    ``arrival`` is the time at which the file of a row was written, and its name: the order
    in which versions of a path that one trigger finds together are taken.
    """
    reader = spark.readStream.schema(SOURCES)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    written = F.unix_micros("_metadata.file_modification_time").cast("string")
    arrival = F.concat_ws("/", F.lpad(written, 20, "0"), "_metadata.file_name")
    return reader.parquet(folder).withColumn("arrival", arrival)


def start_ingest(
    stream: DataFrame,
    store: CatalogStore,
    checkpoint: str,
    *,
    trigger: dict[str, Any] | None = None,
    compact_after: int | None = 100,
    **options: Any,
) -> StreamingQuery:
    """Each micro-batch is one run and one commit, so the result is that of batch runs in
    order of arrival. The catalog is the only state. A batch that is replayed after a
    failure finds its number among the commits and changes nothing. Once more than
    ``compact_after`` runs are to be read, they are folded into one, so the cost of a batch
    does not grow with the number of batches.
    """

    def run(batch: DataFrame, batch_number: int) -> None:
        batch_id = f"{checkpoint}#{batch_number}"
        if not store.has_batch(batch_id):
            ingest(batch, store, batch_id=batch_id, **options).release()
            if compact_after and len(store.runs()) > compact_after:
                store.compact()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
