"""Best-fit decreasing packing of tokenized documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so all documents of one length are alike and
their number is all that the method needs to know of them. The driver gets that histogram,
of at most ``capacity`` rows, and runs best-fit decreasing over runs of equal documents: a
segment tree over remaining capacities finds the tightest one that has open bins, and a run
of documents fills a run of such bins. The outcome is a short list of placements (which
ranks of a length go to which bins, at which offset), the same as one by one. Executors
number the documents within their length and look their place up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callshelf.llm.bpe import bpe, vocabulary_path
from callshelf.llm.common import text_slices, texts_of
from callshelf.session import stage

CAPACITY = 2048
END = 0
#: Pieces that are numbered in one sort.
SLICE_ROWS = 1_000_000
LEAST_SLICES = 256


class OpenBins:
    """Runs of bins by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.leaves)  # runs below each node
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, remaining: int, change: int) -> None:
        node = remaining + self.leaves
        while node:
            self.filled[node] += change
            node >>= 1

    def push(self, remaining: int, first: int, bins: int) -> None:
        if remaining and bins:
            self.runs[remaining].append((first, bins))
            self._add(remaining, 1)

    def pop(self, remaining: int) -> tuple[int, int]:
        self._add(remaining, -1)
        return self.runs[remaining].pop()

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of ``size`` or more that has a bin."""
        node = size + self.leaves
        if self.filled[node]:
            return size
        while node > 1:
            if not node & 1 and self.filled[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.filled[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(
    histogram: dict[int, int], capacity: int
) -> list[tuple[int, int, int, int, int]]:
    """Placements ``(length, from_rank, first_bin, per_bin, offset)``.

    Documents of ``length`` from ``from_rank`` on, up to the next placement of the length,
    go to ``first_bin`` and the bins after it, ``per_bin`` to each, from ``offset`` on.
    """
    open_bins, placements, bins = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = open_bins.tightest(length)
            if remaining is None:  # as many new bins as are left to fill
                remaining = capacity
                per_bin = remaining // length
                first, run = bins, -(-left // per_bin)
                bins += run
            else:
                first, run = open_bins.pop(remaining)
                per_bin = remaining // length
            # The next document of this length fits the bin just used most tightly, so
            # each bin takes per_bin of them before another one does.
            full = min(run, left // per_bin)
            rest = min(left - full * per_bin, per_bin) if full < run else 0
            placements.append((length, rank, first, per_bin, capacity - remaining))
            open_bins.push(remaining - per_bin * length, first, full)
            if rest:
                open_bins.push(remaining - rest * length, first + full, 1)
            used = full + bool(rest)
            open_bins.push(remaining, first + used, run - used)
            rank += full * per_bin + rest
            left -= full * per_bin + rest
    return placements


def token_pieces(
    docs: DataFrame,
    path: str | None = None,
    *,
    capacity: int = CAPACITY,
    end: int = END,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: the pieces of each document.

    A document is its token ids and the id ``end``. Longer ones than ``capacity`` are cut. A
    null or empty text is the end alone.
    """
    path = path or vocabulary_path()
    narrow = docs.select(docs[id_column].alias(id_column), docs[text_column].alias("text"))
    names = [id_column, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, tokens in enumerate(bpe(path).encode_batch(texts_of(batch))):
                tokens.append(end)
                array = np.array(tokens, dtype="<u4")
                for number, begin in enumerate(range(0, len(tokens), capacity)):
                    part = array[begin : begin + capacity]
                    owner.append(i)
                    piece.append(number)
                    start.append(begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    *[pa.array(ids, pa.list_(pa.int32()))] * with_ids,
                ],
                names,
            )

    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType()]
    schema = T.StructType([narrow.schema[id_column]])
    for name, kind in zip(names[1:5], kinds):
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return narrow.mapInArrow(run, schema)


def pack(
    pieces: DataFrame,
    *,
    capacity: int = CAPACITY,
    key_columns: tuple[str, ...] = ("doc_id", "piece"),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``pieces`` (a table, with ``length`` from 1 to ``capacity``) with ``sequence_id`` and
    ``offset``. Repeated rows are pieces of their own; an empty table stays empty."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = {row["length"]: row["count"] for row in counted}
    placements = best_fit_decreasing(histogram, capacity)
    columns = np.array(sorted(placements), dtype=np.int64).reshape(-1, 5).T
    slices = max(LEAST_SLICES, sum(histogram.values()) // slice_rows)

    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64(*key_columns), F.lit(slices)))
    earlier = (
        Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        sliced.groupBy("length", "_slice")
        .count()
        .select("length", "_slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_first"))
    )
    # A length may be that of a third of all pieces; its slices are numbered side by side.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("_slice", "length").orderBy(*key_columns)
    ranked = (
        sliced.repartition(parts, "_slice", "length")
        .withColumn("_place", F.row_number().over(order))
        .join(starts, ["length", "_slice"])
        .withColumn("_rank", F.col("_first") + F.col("_place") - 1)
        .drop("_first", "_place", "_slice")
    )
    schema = T.StructType(
        [
            *[field for field in ranked.schema.fields if field.name != "_rank"],
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    names = schema.fieldNames()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, from_rank, first, per_bin, offset = columns
        keys = (length << 48) | from_rank
        for batch in batches:
            sizes = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (sizes << 48) | ranks, "right") - 1
            bins, places = np.divmod(ranks - from_rank[at], per_bin[at])
            added = [first[at] + bins, offset[at] + places * sizes]
            kept = [batch.column(name) for name in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, added)], names)

    return ranked.mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    *,
    capacity: int = CAPACITY,
    end: int = END,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents (see ``token_pieces``), staged once, and their places.

    ``(id, piece, start, length, ids_crc32[, ids], sequence_id, offset)``. Columns of
    ``docs`` beside id and text play no part.
    """
    pieces = stage(
        token_pieces(
            docs, path, capacity=capacity, end=end, id_column=id_column,
            text_column=text_column, with_ids=with_ids,
        ),
        "pieces",
    )
    placed = pack(pieces, capacity=capacity, key_columns=(id_column, "piece"))
    return placed.select(*pieces.columns, "sequence_id", "offset")
