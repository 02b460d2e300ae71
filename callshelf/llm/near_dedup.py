"""Near-duplicate documents by a chosen-path set similarity join over min-hashes.

A document is its set of word shingles. Documents of one set are one class, and classes are
what is joined. Independent trees branch the classes: a node chooses some positions of the
min-hash signature and hands each of its classes to the children named after the values
there, so a pair of similarity ``s`` goes on together along a share ``s`` of the paths.
With ``BRANCHES`` = 3 paths per node and 3 trees a pair at 0.75 is missed about once in
a hundred thousand. Small nodes are compared exhaustively.

What must come out is which classes hang together, so nodes work on components. A node whose
classes hang together already is done: this is how a group of thousands of near copies ends,
without all of its pairs. First all classes of a node are compared with one member of it,
then small nodes exhaustively, then large ones branch. Dense nodes, and what is still large
at the last level, hold classes that branching cannot tell apart: there the classes outside
the largest component are compared with all, block by block.

Signatures say which classes of a node are likely to have a partner (an estimate far below
the threshold is the only ground to pass one over), and full shingle sets confirm each link.
A node hands on as many links as tie its components together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from callshelf.llm.common import free_name, text_slices, texts_of
from callshelf.llm.components import bounded, components, stage_narrow
from callshelf.session import small_batches, stage

SHINGLE = 5
#: Link: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
POSITIONS = 64
TREES = 3
BRANCHES = 3
DEPTH = 2
#: Nodes of as many classes or fewer are compared exhaustively.
SMALL_NODE = 256
BLOCK = 1024
#: Larger nodes whose classes are on average so similar to one of them are not branched:
#: most paths would keep them together.
DENSE = 0.4
#: Pairs of a lower estimate are not confirmed: 4.6 standard deviations below the threshold.
LEAST_ESTIMATE = 0.5
#: Shingle sets a task takes.
WIDE_ROWS = 5_000
#: Rows (texts, pairs of sets, nodes with their sets) that a Python step takes at a time.
BATCH_ROWS = 512

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_STEPS = _mixed(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64) * _PRIME)
_MULTIPLY, _ADD = _STEPS[:POSITIONS] | np.uint64(1), _STEPS[POSITIONS:]


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    A-Z count as a-z. A text of fewer words than ``size`` is one shingle, one without words
    has none.
    """
    split = [text.encode("utf-8", "surrogatepass").lower().split() for text in texts]
    # of these texts only: kept for later ones, rare words would fill the memory of a worker
    distinct = set().union(*split)
    hashes = dict(zip(distinct, map(_word_hash, distinct)))
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = np.fromiter(
        (hashes[word] for words in split for word in words), np.uint64, int(counts.sum())
    )
    rolled = np.zeros(max(0, len(flat) - size + 1), dtype=np.uint64)
    for i in range(size):
        rolled = rolled * _PRIME + flat[i : i + len(rolled)]
    rolled = _mixed(rolled)
    sets, start = [], 0
    for count in counts.tolist():
        if count >= size:
            sets.append(np.unique(rolled[start : start + count - size + 1]))
        elif count:
            value = np.uint64(count)
            for word in flat[start : start + count]:
                value = np.uint64((int(value) * int(_PRIME) + int(word)) & ((1 << 64) - 1))
            sets.append(_mixed(np.array([value], dtype=np.uint64)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
        start += count
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hashes, sets x positions, as unsigned 32-bit numbers; 0 for empty sets."""
    result = np.zeros((len(sets), POSITIONS), dtype=np.uint32)
    full = [i for i, one in enumerate(sets) if len(one)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        sizes = np.array([len(sets[i]) for i in full])
        begins = np.cumsum(sizes) - sizes
        for position in range(POSITIONS):
            hashed = (flat * _MULTIPLY[position] + _ADD[position]) >> np.uint64(32)
            result[full, position] = np.minimum.reduceat(hashed, begins)
    return result


def described(
    docs: DataFrame, id_column: str, text_column: str, carry: str | None = None
) -> DataFrame:
    """``(id, n_shingles, class, signature[, carry])``: ``class`` is a digest of the set, null
    if empty; ``carry`` is passed through as it is."""
    narrow = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"),
                         *([docs[carry].alias(carry)] if carry else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(texts_of(batch))
            digests = [
                hashlib.blake2b(one.tobytes(), digest_size=16).digest() if len(one) else None
                for one in sets
            ]
            rows = [row.tobytes() if len(s) else None for row, s in zip(signatures(sets), sets)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(rows, pa.binary()),
                    *([batch.column(2)] if carry else []),
                ],
                ["id", "n_shingles", "class", "signature", *([carry] if carry else [])],
            )

    schema = T.StructType(
        [
            narrow.schema["id"],
            T.StructField("n_shingles", T.LongType()),
            T.StructField("class", T.BinaryType()),
            T.StructField("signature", T.BinaryType()),
            *([narrow.schema[carry]] if carry else []),
        ]
    )
    return narrow.mapInArrow(run, schema)


def fetched_sets(
    docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str
) -> DataFrame:
    """``(id, shingles)`` of the documents in ``wanted(id)``, computed anew from their texts."""
    narrow = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    chosen = narrow.join(bounded(wanted), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = [one.tobytes() for one in shingle_sets(texts_of(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"]
            )

    schema = T.StructType([narrow.schema["id"], T.StructField("shingles", T.BinaryType())])
    return chosen.mapInArrow(run, schema)


def is_link(left: np.ndarray, right: np.ndarray, similarity: int = SIMILARITY) -> bool:
    """Are two sorted sets similar enough?"""
    if len(left) > len(right):
        left, right = right, left
    if 100 * len(left) < similarity * len(right) or not len(left):
        return False
    at = np.searchsorted(right, left).clip(max=len(right) - 1)
    common = int((right[at] == left).sum())
    return 100 * common >= similarity * (len(left) + len(right) - common)


def _signature_rows(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=np.uint32).reshape(-1, POSITIONS)


class _Join:
    """The state of one join: classes, their components, and the pairs already judged."""

    def __init__(self, classes: DataFrame, sets: DataFrame, similarity: int) -> None:
        self.spark = classes.sparkSession
        self.classes = classes  # vertex, signature
        self.sets = sets  # id, shingles
        self.similarity = similarity
        self.rows = 0
        self.judged: DataFrame | None = None
        self.roots: DataFrame | None = None

    def with_roots(self, members: DataFrame) -> DataFrame:
        """``members`` with the root of each vertex."""
        if self.roots is None:
            return members.withColumn("root", F.col("vertex"))
        return members.join(bounded(self.roots), "vertex", "left").withColumn(
            "root", F.coalesce("root", "vertex")
        )

    def open_nodes(self, members: DataFrame) -> DataFrame:
        """``(node, vertex, root, size)`` of nodes with more than one component."""
        rooted = self.with_roots(members)
        nodes = stage_narrow(
            rooted.groupBy("node")
            .agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("l"), F.max("root").alias("h"))
            .where("l <> h")
            .select("node", "size"),
            "open",
            self.rows,
        )
        found = stage_narrow(rooted.join(bounded(nodes), "node"), "nodes", self.rows)
        self.rows = found.count()
        return found

    def confirm(self, pairs: DataFrame) -> None:
        """Judge ``pairs(a, b)`` on full sets, and let the components grow by the links."""
        fresh = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.judged is not None:
            fresh = fresh.join(self.judged, ["a", "b"], "left_anti")
        fresh = stage_narrow(fresh, "pairs", self.rows)
        if fresh.isEmpty():
            return
        # Pairs go to where the sets are; only the sets of pairs are shuffled.
        first = self.sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        second = self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        second = second.join(bounded(fresh.select("b").distinct()), "b", "left_semi")
        similarity = self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                linked = [
                    is_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity)
                    for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())],
                    ["a", "b", "linked"],
                )

        schema = T.StructType(
            [*fresh.schema.fields, T.StructField("linked", T.BooleanType())]
        )
        result = stage_narrow(
            first.join(bounded(fresh), "a").join(second, "b").select("a", "b", "sa", "sb")
            .mapInArrow(run, schema),
            "judged",
            self.rows,
            WIDE_ROWS,
        )
        self.judged = fresh if self.judged is None else self.judged.unionByName(fresh)
        self.grow(result.where("linked").select("a", "b"))

    def grow(self, links: DataFrame) -> None:
        """Let the components grow: what is new are links between their roots."""
        if self.roots is None:
            self.roots = components(links, self.rows)
            return
        known = bounded(self.roots)
        for end in ("a", "b"):
            own = known.select(F.col("vertex").alias(end), F.col("root").alias("_root"))
            links = links.join(own, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
        moved = components(links, self.rows)
        if moved.isEmpty():
            return
        after = bounded(moved.select(F.col("vertex").alias("root"), F.col("root").alias("to")))
        kept = self.roots.join(after, "root", "left").select(
            "vertex", F.coalesce("to", "root").alias("root")
        )
        # vertices that had no link before
        fresh = moved.join(self.roots.select("vertex"), "vertex", "left_anti")
        self.roots = stage_narrow(kept.unionByName(fresh), "roots", self.rows)

    def _estimated(self, pairs: DataFrame) -> DataFrame:
        """``pairs(a, b)`` with the estimate of their similarity."""
        first = self.classes.select(F.col("vertex").alias("a"), F.col("signature").alias("x"))
        second = self.classes.select(F.col("vertex").alias("b"), F.col("signature").alias("y"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    same = _signature_rows(batch.column("x")) == _signature_rows(batch.column("y"))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("a"), batch.column("b"), pa.array(same.mean(axis=1))],
                        ["a", "b", "estimate"],
                    )

        schema = T.StructType([*pairs.schema.fields, T.StructField("estimate", T.DoubleType())])
        return (
            pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
            .mapInArrow(run, schema)
        )

    def with_leaders(self, members: DataFrame, seed: int) -> DataFrame:
        """Pairs of each vertex and the most similar of its nodes' leaders, one per node."""
        order = F.struct(F.xxhash64("vertex", "node", F.lit(seed)), F.col("vertex"), F.col("root"))
        leaders = members.groupBy("node").agg(F.min(order).alias("l")).select(
            "node", F.col("l.vertex").alias("b"), F.col("l.root").alias("leader_root")
        )
        pairs = (
            members.join(leaders, "node")
            .where("root <> leader_root")
            .select(F.col("vertex").alias("a"), "b")
            .distinct()
        )
        likely = self._estimated(pairs).where(F.col("estimate") >= LEAST_ESTIMATE)
        best = likely.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("best"))
        return best.select("a", F.col("best.b").alias("b"))

    def dense(self, nodes: DataFrame) -> DataFrame:
        """``(node)`` of those nodes whose classes are similar to a leader on average."""
        order = F.struct(F.xxhash64("vertex", "node"), F.col("vertex"))
        leaders = nodes.groupBy("node").agg(F.min(order)["vertex"].alias("b"))
        pairs = nodes.select("node", F.col("vertex").alias("a")).join(leaders, "node")
        estimated = self._estimated(pairs.select("a", "b").distinct())
        return stage_narrow(
            pairs.join(estimated, ["a", "b"])
            .groupBy("node")
            .agg(F.avg("estimate").alias("mean"))
            .where(F.col("mean") >= DENSE)
            .select("node"),
            "dense",
            0,
        )

    def links_within(self, nodes: DataFrame) -> DataFrame:
        """``(a, b)``: links that tie the components of bounded nodes together.

        All classes of ``nodes(node, vertex, root, side)`` are compared; with sides 0 and 1
        only across them. Signatures first leave the classes that have a likely partner in
        another component, then those are compared by the sizes of all intersections.
        """
        kind = self.classes.schema["vertex"].dataType
        fields = ("vertex", "root", "side")

        def gathered(rows: DataFrame, column: str) -> DataFrame:
            parts = F.collect_list(F.struct(*fields, column)).alias("m")  # a bounded node
            lists = [F.col(f"m.{name}").alias(name) for name in (*fields, column)]
            return rows.groupBy("node").agg(parts).select("node", *lists)

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chosen = [[] for _ in range(4)]
                for row in range(batch.num_rows):
                    vertex, root, side = (batch.column(n)[row].values for n in fields)
                    labels = np.asarray(root.dictionary_encode().indices)
                    sides = np.asarray(side)
                    known = _signature_rows(batch.column("signature")[row].values)
                    has = np.zeros(len(labels), dtype=bool)
                    for i in range(len(labels)):
                        others = (labels != labels[i]) & ((sides == 2) | (sides != sides[i]))
                        at = np.flatnonzero(others)
                        if len(at):
                            near = (known[at] == known[i]).mean(axis=1) >= LEAST_ESTIMATE
                            has[i] = near.any()
                    kept = np.flatnonzero(has)
                    if len(kept):
                        chosen[0].extend([batch.column("node")[row].as_py()] * len(kept))
                        for part, values in zip(chosen[1:], (vertex, root, side)):
                            part.extend(values.take(pa.array(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(chosen, types)], ["node", *fields]
                )

        types = [
            pa.int64(), *[to_arrow_type(nodes.schema[name].dataType) for name in fields]
        ]
        schema = T.StructType(
            [T.StructField("node", T.LongType()), *[nodes.schema[name] for name in fields]]
        )
        similarity = self.similarity

        def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = [], []
                for row in range(batch.num_rows):
                    vertex, root, side = (batch.column(n)[row].values for n in fields)
                    sets = _arrow_sets(batch.column("shingles")[row].values)
                    labels = np.asarray(root.dictionary_encode().indices)
                    for i, j in _ties(sets, labels, np.asarray(side), similarity):
                        left.append(vertex[i].as_py())
                        right.append(vertex[j].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left, types[1]), pa.array(right, types[1])], ["a", "b"]
                )

        signed = nodes.select("node", *fields).join(self.classes, "vertex")
        candidates = gathered(signed, "signature").mapInArrow(likely, schema)
        candidates = stage_narrow(candidates, "likely", self.rows, 10 * WIDE_ROWS)
        sets = self.sets.withColumnRenamed("id", "vertex")
        with_sets = gathered(sets.join(bounded(candidates), "vertex"), "shingles")
        pair = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
        return stage_narrow(with_sets.mapInArrow(tied, pair), "tied", self.rows, WIDE_ROWS)

    def in_blocks(self, nodes: DataFrame) -> DataFrame:
        """Large nodes as pairs of blocks: the classes outside the largest component against all."""
        by_root = nodes.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n"))
        facts = by_root.groupBy("node").agg(
            F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all")
        ).select(
            "node",
            F.col("main.root").alias("main"),
            F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("outer"),
            F.ceil(F.col("all") / BLOCK).cast("int").alias("inner"),
        )
        placed = nodes.select("node", "vertex", "root").join(facts, "node")

        def cut(blocks: str, other: str, side: int) -> DataFrame:
            own = F.pmod(F.xxhash64("vertex", F.lit(side)), F.col(blocks)).cast("int")
            each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
            cells = placed.select("*", own.alias("_own"), each.alias("_other"))
            pair = ["_own", "_other"] if side == 0 else ["_other", "_own"]
            return cells.where("root <> main" if side == 0 else "true").select(
                F.xxhash64("node", *pair).alias("node"), "vertex", "root",
                F.lit(side).alias("side"),
            )

        return cut("outer", "inner", 0).unionByName(cut("inner", "outer", 1))


def _arrow_sets(values: pa.Array) -> list[np.ndarray]:
    """Shingle sets of a binary array as views of its data buffer, without a copy."""
    if len(values) == 0:
        return []
    wide = pa.types.is_large_binary(values.type)
    bounds = np.frombuffer(values.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = bounds[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)
    return [data[offsets[i]:offsets[i + 1]].view(np.uint64) for i in range(len(values))]


#: Columns of the matrix of shared shingles that are multiplied at a time.
_COLUMNS = 4096


def _ties(
    sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, similarity: int
) -> list[tuple[int, int]]:
    """Links between sets of different labels, as many as tie the labels together.

    Intersections are counted by a product of the matrix of sets and shared shingles.
    """
    sizes = np.array([len(one) for one in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, counts = np.unique(
        np.concatenate(sets), return_inverse=True, return_counts=True
    )
    shared = np.cumsum(counts > 1) - 1
    inside = counts[column] > 1
    owner, column = owner[inside], shared[column[inside]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows = np.flatnonzero(sides != 1)  # all, or side 0
    others = np.flatnonzero(sides != 0)
    common = np.zeros((len(rows), len(others)), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        low, high = np.searchsorted(column, [start, start + _COLUMNS])
        matrix = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        matrix[owner[low:high], column[low:high] - start] = 1.0
        common += matrix[rows] @ matrix[others].T
    union = sizes[rows][:, None] + sizes[others] - common
    linked = (100 * common >= similarity * union) & (labels[rows][:, None] != labels[others])
    top = list(range(int(labels.max()) + 1))

    def find(label: int) -> int:
        while top[label] != label:
            top[label] = top[top[label]]
            label = top[label]
        return label

    ties = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = find(int(labels[rows[i]])), find(int(labels[others[j]]))
        if a != b:
            top[a] = b
            ties.append((int(rows[i]), int(others[j])))
    return ties


def _value(position) -> F.Column:
    """The four bytes of the signature at a position."""
    return F.expr("signature").substr(position * 4 + 1, F.lit(4))


def near_duplicates(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    similarity: int = SIMILARITY,
    trees: int = TREES,
    branches: int = BRANCHES,
    depth: int = DEPTH,
    small_node: int = SMALL_NODE,
    carry: str | None = None,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept[, carry])`` of each row of ``docs``.

    Rows of equal sets belong together, and rows linked directly or by others do. ``kept`` is
    true for the row whose id is the smallest of its component. A null or empty text, or one
    of white space, has an empty set and is linked with nothing. Repeated rows get the same
    result each. Other columns play no part, but ``carry`` is passed through; an empty table
    gives an empty result. Texts whose sets have the same smallest id meet in one vertex, so
    their components are one; texts whose smallest ids differ stay apart even if an id is in
    both. A class whose rows all have null ids has a null component_id and kept.
    """
    if trees * branches > POSITIONS // 2:
        raise ValueError("Too many trees for the positions of a signature")
    with small_batches(docs.sparkSession, BATCH_ROWS):
        rows, named = _components_of(
            docs, id_column, text_column, similarity, trees, branches, depth, small_node, carry
        )
    return (
        rows.drop("signature")
        .join(named, "class", "left")
        .select(
            F.col("id").alias(id_column),
            "n_shingles",
            F.coalesce("component_id", "id").alias("component_id"),
            (F.coalesce("component_id", "id") == F.col("id")).alias("kept"),
            *([carry] if carry else []),
        )
    )


def _components_of(
    docs: DataFrame, id_column: str, text_column: str, similarity: int, trees: int,
    branches: int, depth: int, small_node: int, carry: str | None,
) -> tuple[DataFrame, DataFrame]:
    """What ``described`` says of each row, and ``(class, component_id)``. All Python steps
    have run when it returns."""
    rows = stage(described(docs, id_column, text_column, carry), "described")
    classes = stage(
        rows.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.min("id").alias("vertex"), F.first("signature").alias("signature")),
        "classes",
    )
    roots = F.array(
        *[
            F.xxhash64(F.lit(i), _value(F.lit(i)))
            for i in range(trees * branches)
        ]
    )
    members = classes.select(F.explode(roots).alias("node"), "vertex")
    shared = members.groupBy("node").count().where("count > 1").select("node")
    members = stage(members.join(bounded(stage(shared, "shared")), "node"), "members")
    wanted = stage(members.select(F.col("vertex").alias("id")).distinct(), "wanted")
    # A repeated row repeats its set, which adds nothing to what links with what.
    sets = stage(fetched_sets(docs, wanted, id_column, text_column), "sets")
    known = stage(
        classes.select("vertex", "signature").join(
            bounded(wanted.withColumnRenamed("id", "vertex")), "vertex", "left_semi"
        ),
        "signatures",
    )
    join = _Join(known, sets, similarity)
    first = trees * branches
    width = (POSITIONS - first) // max(1, depth)
    # Leaders come first: they tie groups of copies together before more is compared.
    join.rows = members.count()
    join.confirm(join.with_leaders(join.open_nodes(members), 0))
    for level in range(depth + 1):
        nodes = join.open_nodes(members)
        if nodes.isEmpty():
            break
        small = F.col("size") <= small_node
        join.grow(join.links_within(nodes.where(small).withColumn("side", F.lit(2))))
        large = nodes.where(~small).select("node", "vertex")
        join.confirm(join.with_leaders(join.open_nodes(large), 1))
        nodes = join.open_nodes(large)
        if nodes.isEmpty():
            break
        final = nodes
        if level < depth:
            dense = bounded(join.dense(nodes))
            final = nodes.join(dense, "node", "left_semi")
            nodes = nodes.join(dense, "node", "left_anti")
        join.grow(join.links_within(join.in_blocks(final)))
        if level == depth:
            break
        chosen = [
            F.lit(first + level * width) + F.pmod(F.xxhash64("node", F.lit(level)) + F.lit(b), width)
            for b in range(branches)
        ]
        children = F.array(
            *[F.xxhash64("node", F.lit(b), _value(p.cast("int"))) for b, p in enumerate(chosen)]
        )
        grown = nodes.join(join.classes, "vertex").select(
            F.explode(children).alias("node"), "vertex"
        )
        grown = stage(grown, "children")
        shared = grown.groupBy("node").count().where("count > 1").select("node")
        members = stage(grown.join(bounded(stage(shared, "shared")), "node"), "members")
    named = classes.select("class", "vertex")
    if join.roots is not None:
        least = join.roots.groupBy("root").agg(F.min("vertex").alias("least"))
        ends = join.roots.join(bounded(least), "root").select("vertex", "least")
        named = named.join(bounded(stage(ends, "ends")), "vertex", "left")
    else:
        named = named.withColumn("least", F.col("vertex"))
    return rows, named.select("class", F.coalesce("least", "vertex").alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each component, all columns.

    Decided by row, not by id: a row stays if ``near_duplicates`` keeps it (its id is its
    component's smallest) and it is the chosen row of its component (the one with the
    smallest content key), so near copies under one id leave one row, and a text that
    shares its id with a text elsewhere is not lost. Rows with an empty set (null, empty or
    blank text) are linked with nothing and stay. A row with a null id stays only if no row
    with an id shares its component; such rows are not compared among themselves. Of rows
    equal in every column one stays.

    Rows are told apart by a content key (two 64-bit hashes of all columns), so the input is
    read again instead of written once more. The rows that go are few beside the texts, so
    those are what is looked up, by broadcast if they are few and by a shuffle beyond; only
    rows that repeat exactly are shuffled, to leave one.
    """
    key = free_name(docs, "_key")
    every = [docs[c] for c in docs.columns]
    keyed = docs.withColumn(key, F.struct(
        F.xxhash64(*every).alias("a"), F.xxhash64(F.lit("second"), *every).alias("b")
    ))
    judged = stage(
        near_duplicates(keyed, id_column=id_column, carry=key, **options).select(
            key, "kept", "component_id", "n_shingles"
        ),
        "near-kept",
    )
    alone = (F.col("n_shingles") == 0) | F.col("component_id").isNull()
    candidate = judged.where(F.coalesce("kept", F.col("component_id").isNull()))
    firsts = candidate.where(~alone).groupBy("component_id").agg(F.min(key).alias(key))
    staying = candidate.where(alone).select(key).unionByName(firsts.select(key)).distinct()
    gone = bounded(stage(judged.select(key).distinct().join(staying, key, "left_anti"),
                         "near-gone"))
    again = bounded(stage(
        judged.join(staying, key, "left_semi").groupBy(key).count().where("count > 1")
        .select(key),
        "near-again",
    ))
    left = keyed.join(gone, key, "left_anti")
    once = left.join(again, key, "left_anti")
    repeated = left.join(again, key, "left_semi").dropDuplicates([key])
    return once.unionByName(repeated).drop(key)
