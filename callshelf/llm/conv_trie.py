"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of the first ``d`` turns (role, text) of a conversation; the
root is the empty sequence. Its members are the conversations that start with it.

How it runs on a cluster:

* **Nodes without texts.** Each turn becomes a position-keyed hash of (position, role,
  text) in four 31-bit lanes. The key of a prefix is the lane-wise sum of its turns modulo
  2^31 (124 bits and the depth), a running sum over the turns of one conversation; a parent's
  key is the child's minus its last turn. Texts leave after this step: only keys, byte
  counts and ids are shuffled. Two different prefixes of one depth share a key with
  chance about n^2 / 2^125 for n nodes.
* **Members to nodes.** One row per conversation and depth is grouped by node key: counts,
  smallest member and the members that end there are partial aggregates.
* **Subtree totals, time-forward.** Below ``CUT`` (default depth 2) every node belongs to the
  shard of its ancestor at depth ``CUT``. Shards are hashed to partitions, and each partition
  is sorted by shard, depth descending and key (Spark's external sort, which spills). One
  pass over the sorted rows keeps a priority queue of messages keyed by the receiver's place
  in that order: a node pops the messages addressed to it, adds its own value and pushes the
  total to its parent. Shard roots at depth ``CUT`` send their totals across shards: the
  ``CUT`` top levels add their children's totals by grouping on the parent key.

A very common first turn holds many shards below it, so it is spread; a subtree below
depth ``CUT`` stays in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callshelf.session import stage

#: Depth of the shard roots.
CUT = 2
#: Original turns a conversation takes from the one it is based on: crc32 of its id mod this.
BORROW_MOD = 9
#: Conversations are based on the one whose id is their own less its rest mod this.
BASE_MOD = 5

_MOD = 1 << 31
_LANES = ("a", "b", "c", "d")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns by turn (null first), then role and text; pos from 1.

    Null role or text reads as empty; rows without conv_id belong to no conversation.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), "role", "text"
    )
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("pos"),
                        "role", "text")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, pos, role, text) and conversations (conv_id, length).

    Conversation c takes the first h = crc32(decimal c) mod 9 turns of conversation
    b = c - c % 5 (all if fewer, none if b is absent), then its own turns after its first h.
    """
    turns = stage(ordered_turns(conversations), "trie-turns")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base_of = F.col("conv_id") - F.col("conv_id") % BASE_MOD
    convs = (
        counts.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % BORROW_MOD).cast("long"))
        .withColumn("b", base_of)
        .alias("c")
        .join(counts.select(F.col("conv_id").alias("b"), F.col("n").alias("nb")), "b", "left")
        .select(
            "conv_id", "n", "h",
            F.least(F.col("h"), F.coalesce(F.col("nb"), F.lit(0))).alias("m"),
        )
        .withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    convs = stage(convs, "trie-convs")
    # turns of a base go to the conversations based on it: ids within BASE_MOD - 1 of it
    borrowed = (
        turns.where(F.col("pos") <= BORROW_MOD - 1)
        .withColumn("user", F.explode(F.sequence(F.col("conv_id") - (BASE_MOD - 1),
                                                 F.col("conv_id") + (BASE_MOD - 1))))
        .where(F.col("user") - F.col("user") % BASE_MOD == F.col("conv_id"))
        .join(convs.select(F.col("conv_id").alias("user"), "m"), "user")
        .where(F.col("pos") <= F.col("m"))
        .select(F.col("user").alias("conv_id"), "pos", "role", "text")
    )
    own = (
        turns.join(convs.select("conv_id", "h", "m"), "conv_id")
        .where(F.col("pos") > F.col("h"))
        .select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("pos"), "role", "text")
    )
    return borrowed.unionByName(own), convs.select("conv_id", "length")


def _lanes(pos, role, text) -> list:
    first = F.xxhash64(pos, role, text)
    second = F.xxhash64(F.lit("second lane"), text, role, pos)
    return [
        F.shiftright(first, 0).bitwiseAND(_MOD - 1),
        F.shiftright(first, 31).bitwiseAND(_MOD - 1),
        F.shiftright(second, 0).bitwiseAND(_MOD - 1),
        F.shiftright(second, 31).bitwiseAND(_MOD - 1),
    ]


def member_rows(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and depth 0..length: node key, parent key, shard key."""
    lanes = _lanes(F.col("pos"), F.col("role"), F.col("text"))
    running = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy("conv_id")
    keyed = turns.select(
        "conv_id", "pos", F.octet_length("text").cast("long").alias("bytes"),
        *[lane.alias(f"l_{n}") for n, lane in zip(_LANES, lanes)],
    )
    keyed = keyed.select(
        "conv_id", F.col("pos").alias("depth"), "bytes",
        *[(F.sum(f"l_{n}").over(running) % _MOD).alias(f"k_{n}") for n in _LANES],
        *[F.col(f"l_{n}") for n in _LANES],
    )
    keyed = keyed.select(
        "conv_id", "depth", "bytes",
        *[F.col(f"k_{n}") for n in _LANES],
        *[F.pmod(F.col(f"k_{n}") - F.col(f"l_{n}"), F.lit(_MOD)).alias(f"p_{n}") for n in _LANES],
        *[F.max(F.when(F.col("depth") == CUT, F.col(f"k_{n}"))).over(whole).alias(f"s_{n}")
          for n in _LANES],
    )
    roots = convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"),
        *[F.lit(0).cast("long").alias(f"k_{n}") for n in _LANES],
        *[F.lit(None).cast("long").alias(f"p_{n}") for n in _LANES],
        *[F.lit(None).cast("long").alias(f"s_{n}") for n in _LANES],
    )
    return keyed.unionByName(roots).join(convs, "conv_id")


def _key(prefix: str) -> list:
    return [f"{prefix}_{n}" for n in _LANES]


def node_table(members: DataFrame) -> DataFrame:
    """Nodes: key, parent key, shard key, smallest member, members, bytes of the last text,
    digest of the members that end there."""
    ends = F.array_sort(F.collect_list(
        F.when(F.col("length") == F.col("depth"), F.col("conv_id"))
    ))
    return members.groupBy("depth", *_key("k")).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("bytes").alias("bytes"),
        *[F.first(c, ignorenulls=True).alias(c) for c in _key("p") + _key("s")],
        F.sha2(F.array_join(F.transform(ends, lambda c: c.cast("string")), ","), 256)
        .alias("ends_sha256"),
    )


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Time-forward pass over nodes sorted by shard, depth descending and key.

    A node's place in the order is (shard, -depth, key); its parent's place is
    (shard, -(depth - 1), parent key), later in the same order. Messages wait in a heap keyed
    by the receiver's place; a node takes all messages with its own place.
    """
    queue: list = []
    names = ["depth", *_key("k"), "sub_leaves", "sub_saved"]
    for batch in batches:
        cols = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        out = {name: [] for name in names}
        for i in range(batch.num_rows):
            shard = tuple(cols[c][i] for c in _key("s"))
            depth = cols["depth"][i]
            key = tuple(cols[c][i] for c in _key("k"))
            place = (shard, -depth, key)
            leaves, saved = cols["own_leaves"][i], cols["own_saved"][i]
            while queue and queue[0][0] <= place:
                target, child_leaves, child_saved = heapq.heappop(queue)
                if target != place:
                    raise ValueError(f"a message to {target} found no node")
                leaves += child_leaves
                saved += child_saved
            if depth > CUT:
                parent = (shard, -(depth - 1), tuple(cols[c][i] for c in _key("p")))
                heapq.heappush(queue, (parent, leaves, saved))
            for name, value in zip(names, (depth, *key, leaves, saved)):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
            [(name, pa.int64()) for name in names]
        ))
    if queue:
        raise ValueError(f"{len(queue)} messages found no node")


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(depth, key, n_leaves, saved_tokens) of every node: totals over its subtree."""
    spark = nodes.sparkSession
    own = nodes.select(
        "depth", *_key("k"), *_key("p"), *_key("s"),
        (F.col("n_children") == 0).cast("long").alias("own_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("own_saved"),
    )
    deep = own.where(F.col("depth") >= CUT)
    parts = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_shards = deep.repartition(parts, *_key("s")).sortWithinPartitions(
        *_key("s"), F.col("depth").desc(), *_key("k")
    )
    schema = "depth long, " + ", ".join(f"{c} long" for c in _key("k")) + \
        ", sub_leaves long, sub_saved long"
    totals = stage(sorted_shards.mapInArrow(_forward, schema), "trie-totals")
    levels = [totals]
    for depth in range(CUT - 1, -1, -1):
        below = levels[-1].where(F.col("depth") == depth + 1)
        parents = own.where(F.col("depth") == depth)
        sums = (
            below.join(own.where(F.col("depth") == depth + 1).select("depth", *_key("k"), *_key("p")),
                       ["depth", *_key("k")])
            .groupBy(*_key("p"))
            .agg(F.sum("sub_leaves").alias("l"), F.sum("sub_saved").alias("s"))
            .select(*[F.col(p).alias(k) for p, k in zip(_key("p"), _key("k"))], "l", "s")
        )
        level = parents.join(sums, _key("k"), "left").select(
            "depth", *_key("k"),
            (F.col("own_leaves") + F.coalesce("l", F.lit(0))).alias("sub_leaves"),
            (F.col("own_saved") + F.coalesce("s", F.lit(0))).alias("sub_saved"),
        )
        levels.append(stage(level, "trie-top"))
    result = levels[0]
    for level in levels[1:]:
        result = result.unionByName(level)
    return result


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' prefix trie.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree,
    each node's ``(n_convs - 1) *`` UTF-8 bytes of its last text), ends_sha256 (SHA-256 of the
    ids of members that end there, ascending, comma-joined). Rows with a null conv_id are
    left out; repeated turns are turns; a table without conversations gives no row. Extra
    columns of ``conversations`` are not read.
    """
    turns, convs = rebuild(conversations.select("conv_id", "turn", "role", "text"))
    members = stage(member_rows(turns, convs), "trie-members")
    nodes = node_table(members)
    children = nodes.where(F.col("depth") > 0).groupBy(
        (F.col("depth") - 1).alias("depth"), *_key("p")
    ).agg(F.count(F.lit(1)).alias("n_children")).select(
        "depth", *[F.col(p).alias(k) for p, k in zip(_key("p"), _key("k"))], "n_children"
    )
    nodes = nodes.join(children, ["depth", *_key("k")], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)).cast("long")
    )
    nodes = stage(nodes, "trie-nodes")
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        *[F.col(k).alias(p) for k, p in zip(_key("k"), _key("p"))],
        F.col("conv_id").alias("parent_conv_id"),
    )
    totals = subtree_totals(nodes)
    return (
        nodes.join(parents, ["depth", *_key("p")], "left")
        .join(totals, ["depth", *_key("k")])
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            F.col("sub_leaves").alias("n_leaves"), F.col("sub_saved").alias("saved_tokens"),
            "ends_sha256",
        )
    )
