"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Equal texts are one group and stay together. A group is indivisible, so the law of the
result is ``bytes``: the largest and the smallest shard differ as little as differencing
can make it.

Differencing needs all its items at one place, so it gets a bounded number of them
whatever the input: groups that hold more than ``1 / (shards * bundles_per_shard)`` of all
bytes (at most ``shards * bundles_per_shard`` of them can) are items of their own, and the
others are bundled by the hash of their text into as many bundles. The bundles are
about equal and far smaller than a shard, and their differences are what the method cancels.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callshelf.llm.common import crc32_of
from callshelf.session import stage

SHARDS = 8
BUNDLES_PER_SHARD = 1024
#: Rows that are numbered in one sort; the driver sums up one count per slice and shard.
SLICE_ROWS = 1_000_000
LEAST_SLICES = 256


def differencing(sizes: list[int], parts: int) -> list[int]:
    """The part of each item, by the largest differencing method.

    Each item starts as a partial partition: itself beside empty parts. The two partial
    partitions of largest spread are combined again and again, the fullest part of one
    with the emptiest of the other, until one is left.
    """
    if not sizes:
        return []
    heap = []
    for item, size in enumerate(sizes):
        sums = (size, *[0] * (parts - 1))
        heap.append((-size, item, sums, (item, *[None] * (parts - 1))))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, order, sums, members = heapq.heappop(heap)
        _, _, other_sums, other_members = heapq.heappop(heap)
        joined = sorted(
            (
                (a + b, m if n is None else n if m is None else (m, n))
                for a, b, m, n in zip(sums, other_sums[::-1], members, other_members[::-1])
            ),
            key=lambda pair: -pair[0],
        )
        least = joined[-1][0]
        heapq.heappush(
            heap,
            (
                least - joined[0][0],
                order,
                tuple(total - least for total, _ in joined),
                tuple(member for _, member in joined),
            ),
        )
    part_of = [0] * len(sizes)
    for part, member in enumerate(heap[0][3]):
        open_members = [member]
        while open_members:
            member = open_members.pop()
            if isinstance(member, tuple):
                open_members.extend(member)
            elif member is not None:
                part_of[member] = part
    return part_of


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    bundles_per_shard: int = BUNDLES_PER_SHARD,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` of each document.

    ``size`` is the text's UTF-8 bytes plus 1. A null text counts as an empty one and
    belongs to the group of the empty texts. Repeated rows are separate documents of one
    group. Other columns play no part. ``slot`` numbers a shard's rows from 0 without
    gaps. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    rows = stage(
        docs.select(
            docs[id_column].alias(id_column),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            crc32_of(text).alias("text_crc32"),
            F.xxhash64(text).alias("_group"),
        ),
        "shard-rows",
    )
    totals = rows.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).first()
    bundles = shards * bundles_per_shard
    bundle = F.pmod(F.col("_group"), F.lit(bundles)).cast("int")
    large = F.col("bytes") * bundles > F.lit(totals["size"] or 0)
    # At most `bundles` groups are large and there are at most `bundles` bundles.
    items = (
        rows.groupBy("_group")
        .agg(F.sum("size").alias("bytes"))
        .select(
            F.when(large, F.col("_group")).alias("large"),
            F.when(~large, bundle).alias("bundle"),
            "bytes",
        )
        .groupBy("large", "bundle")
        .agg(F.sum("bytes").alias("bytes"))
        .collect()
    )
    items.sort(key=lambda item: (-item.bytes, item.large is None, item.large, item.bundle))
    shard_of = differencing([item.bytes for item in items], shards)
    large_shards = spark.createDataFrame(
        [(i.large, s) for i, s in zip(items, shard_of) if i.large is not None],
        "_group long, _large_shard int",
    )
    bundle_shards = spark.createDataFrame(
        [(i.bundle, s) for i, s in zip(items, shard_of) if i.large is None],
        "_bundle int, _bundle_shard int",
    )
    slices = max(LEAST_SLICES, (totals["rows"] or 0) // slice_rows)
    placed = (
        rows.withColumn("_bundle", bundle)
        .join(F.broadcast(large_shards), "_group", "left")
        .join(F.broadcast(bundle_shards), "_bundle", "left")
        .select(
            id_column,
            "size",
            "text_crc32",
            F.coalesce("_large_shard", "_bundle_shard").alias("shard"),
            F.pmod(F.xxhash64(id_column, "_group"), F.lit(slices)).cast("int").alias("_slice"),
        )
    )
    counts = placed.groupBy("_slice", "shard").count().toPandas()
    counts = counts.sort_values(["shard", "_slice"])
    starts = counts.groupby("shard")["count"].cumsum() - counts["count"]
    starts = spark.createDataFrame(
        list(zip(counts["_slice"].tolist(), counts["shard"].tolist(), starts.tolist())),
        "_slice int, shard int, _start long",
    )
    # The rows of a slice are spread over all shards: no task gets a shard whole.
    order = Window.partitionBy("_slice", "shard").orderBy(id_column, "text_crc32", "size")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = placed.repartition(parts, "_slice").withColumn(
        "_place", F.row_number().over(order)
    )
    return numbered.join(starts, ["_slice", "shard"]).select(
        id_column,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_start") + F.col("_place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def spread(sizes: np.ndarray, part_of: np.ndarray, parts: int) -> int:
    """Bytes between the fullest and the emptiest part."""
    sums = np.bincount(part_of, weights=sizes, minlength=parts)
    return int(sums.max() - sums.min())
