"""Merkle manifest of a dataset: leaves, subroots per language, a root, and proofs.

Leaves are digests of whole rows. Per language the leaves, ascending by doc_id, are hashed
in pairs level by level (a last node without partner is hashed alone) until one remains,
the language's subroot; the subroots, ordered by language, give the root the same way. A
proof lists each level's sibling; folding a leaf with it must give the root back.

How it runs on a cluster (cogrouped subtree exchange):

* **Places.** Leaves are ranked within their language by a global sort: each sorted
  partition counts its rows per language, a small table of those counts gives offsets. A
  language with a third of all rows is spread over many partitions like any other.
* **Superblocks.** Aligned runs of ``2**BITS`` leaves are complete subtrees, so each is
  reduced alone in ``applyInPandas``; only its root leaves the task. The roots form the
  next tier, reduced the same way, until each language has one node; the subroots form the
  language tier. Outer tiers hold ``2**-BITS`` of the rows of the one below.
* **Cogroup.** The leaves of a superblock and the outer nodes it needs (its siblings on the
  way to the root, one row per superblock) meet in one cogrouped ``applyInPandas``, which
  finishes the local reduction, joins local and outer proof, and folds the tampered leaf.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callshelf.llm.common import crc32_of
from callshelf.session import stage

#: A superblock holds 2**BITS nodes of its tier.
BITS = 10
#: Tampering marks rows whose unsigned crc32 of the decimal doc_id this divides.
TAMPER_MOD = 7
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, and the value (integers in decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encode(v) for v in values]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, group, leaf, tampered): the row's digest, and that of its tampered copy.

    ``group`` orders languages: null first, then by UTF-8 bytes. Rows whose unsigned crc32
    of the decimal doc_id is divisible by 7 (a null doc_id counts as the empty string, whose
    crc32 is 0) have ``n_chars`` one larger when tampered; a null ``n_chars`` stays null,
    and the largest long becomes null.
    """
    cols = [F.col(c) for c in _FIELDS]
    hit = crc32_of(F.col("doc_id")) % TAMPER_MOD == 0
    changed = F.when(hit, F.try_add(F.col("n_chars").cast("long"), F.lit(1))).otherwise(
        F.col("n_chars").cast("long")
    )
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.concat(F.when(F.col("lang").isNull(), "0").otherwise("1"),
                 F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("g"),
        leaf_digest(*cols).alias("leaf"),
        leaf_digest(cols[0], cols[1], cols[2], F.when(F.col("n_chars").isNull(), None)
                    .otherwise(changed), cols[4]).alias("tampered"),
    )


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` with ``idx`` (0-based place within ``group`` by ``order``) and ``n`` (group size).

    A global sort deals the rows; each sorted partition numbers its rows, and offsets come
    from a table of counts by partition and group. The sorted rows are written once, so both
    uses see the same partitions.
    """
    sorted_rows = stage(
        df.orderBy(group, *order).withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id()),
        "merkle-sorted",
    )
    local = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)
    counts = sorted_rows.groupBy(group, "_part").agg(
        F.min(local).alias("_first"), F.count(F.lit(1)).alias("_count")
    )
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = counts.select(
        group, "_part", "_first",
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"),
        F.sum("_count").over(Window.partitionBy(group)).alias("n"),
    )
    return sorted_rows.join(counts, [group, "_part"]).select(
        *df.columns,
        (F.col("_offset") + local - F.col("_first")).alias("idx"),
        "n",
    )


def reduce_block(places, digests, n: int, bits: int):
    """Reduce one aligned block of a tier of a group with ``n`` nodes.

    Returns the block's root and, per node, its sides (``L``: sibling to the right, ``R``:
    to the left, ``S``: alone) and siblings, concatenated, up to that root.
    """
    level = dict(zip(places, digests))
    sides = [[] for _ in places]
    sibs = [[] for _ in places]
    count, k = n, 0
    while count > 1 and k < bits:
        for m, place in enumerate(places):
            a = place >> k
            if a % 2:
                sides[m].append("R")
                sibs[m].append(level[a - 1])
            elif a + 1 < count:
                sides[m].append("L")
                sibs[m].append(level[a + 1])
            else:
                sides[m].append("S")
        nxt = {}
        for j in sorted({a >> 1 for a in level}):
            left = level[2 * j]
            nxt[j] = _h(left + level[2 * j + 1]) if 2 * j + 1 < count else _h(left)
        level, count, k = nxt, (count + 1) // 2, k + 1
    (root,) = level.values()
    return root, ["".join(s) for s in sides], ["".join(s) for s in sibs]


def fold(digest: str, sides: str, sibs: str) -> str:
    """Fold a digest with its proof, level by level."""
    at = 0
    for side in sides:
        if side == "L":
            digest = _h(digest + sibs[at:at + 64])
            at += 64
        elif side == "R":
            digest = _h(sibs[at:at + 64] + digest)
            at += 64
        else:
            digest = _h(digest)
    return digest


def _tier(nodes: DataFrame, with_steps: bool) -> DataFrame:
    """Reduce each superblock of a tier: (g, idx, n, digest) -> rows with the block's root.

    Rows: (g, idx, sides, sibs, block_root); sides and sibs are empty without
    ``with_steps``, and then only the first node of each block is given.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        places = pdf["idx"].tolist()
        root, sides, sibs = reduce_block(places, pdf["digest"].tolist(), int(pdf["n"].iloc[0]), BITS)
        if not with_steps:
            places, sides, sibs = places[:1], [""], [""]
        return pd.DataFrame({
            "g": pdf["g"].iloc[0], "idx": places, "sides": sides, "sibs": sibs,
            "block_root": root,
        })

    return nodes.groupBy("g", F.shiftright("idx", BITS).alias("block")).applyInPandas(
        run, "g string, idx long, sides string, sibs string, block_root string"
    )


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps of each node of a tier (g, idx, n, digest) up to its group's top, and the tops.

    Returns (g, idx, sides, sibs) and (g, top). Each tier reduces its superblocks and
    hands their roots, ``2**-BITS`` as many rows, to the next; a group whose tier has one
    node is done.
    """
    if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
        return (
            nodes.select("g", "idx", F.lit("").alias("sides"), F.lit("").alias("sibs")),
            nodes.select("g", F.col("digest").alias("top")),
        )
    done = stage(_tier(nodes, with_steps=True), "merkle-tier")
    up_steps, tops = climb(_roots(done))
    steps = done.withColumn("_up", F.shiftright("idx", BITS)).join(
        up_steps.select("g", F.col("idx").alias("_up"), F.col("sides").alias("_s"),
                        F.col("sibs").alias("_p")),
        ["g", "_up"],
    )
    steps = steps.select(
        "g", "idx", F.concat("sides", "_s").alias("sides"), F.concat("sibs", "_p").alias("sibs")
    )
    return stage(steps, "merkle-steps"), tops


def _roots(done: DataFrame) -> DataFrame:
    """The block roots of a reduced tier as the next tier's nodes (g, idx, n, digest)."""
    first = done.where(F.col("idx") == F.shiftleft(F.shiftright("idx", BITS), BITS))
    roots = first.select(
        "g", F.shiftright("idx", BITS).alias("idx"), F.col("block_root").alias("digest")
    )
    counts = roots.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return stage(roots.join(counts, "g"), "merkle-roots")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` digests doc_id, source, lang, n_chars and text (nulls as ``-``); within a
    language leaves ascend by doc_id (null first, ties by leaf; equal rows are
    interchangeable). ``proof_sha256`` is the SHA-256 of the proof's sibling digests from the
    leaf to the root; ``folded_root`` folds the tampered leaf with that proof and
    ``verified`` says whether it equals ``root``. Repeated rows are separate leaves; a table
    without rows gives no row; columns other than the five are not read.
    """
    base = ranked(leaves(docs.select(*_FIELDS)), "g", "doc_id", "leaf")
    base = stage(base, "merkle-leaves")
    first = _roots(_tier(base.select("g", "idx", "n", F.col("leaf").alias("digest")),
                         with_steps=False))
    block_steps, subroots = climb(first)
    # the languages' subroots, in order, are one group of the same tiers
    langs = ranked(subroots.select(F.col("g").alias("lang"), F.col("top").alias("digest"),
                                   F.lit("").alias("g")), "g", "lang")
    langs = stage(langs, "merkle-langs")
    lang_steps, root = climb(langs.select("g", "idx", "n", "digest"))
    per_lang = (
        langs.select("g", "lang", "idx", F.col("digest").alias("subroot"))
        .join(lang_steps, ["g", "idx"])
        .join(root.select("g", F.col("top").alias("root")), "g")
        .select(F.col("lang").alias("g"), "subroot", "root",
                F.col("sides").alias("_s"), F.col("sibs").alias("_p"))
    )
    outer = block_steps.join(per_lang, "g").select(
        "g", F.col("idx").alias("block"), F.concat("sides", "_s").alias("sides"),
        F.concat("sibs", "_p").alias("sibs"), "subroot", "root",
    )
    return _finish(base, stage(outer, "merkle-outer"))


def _finish(base: DataFrame, outer: DataFrame) -> DataFrame:
    """Cogroup each superblock's leaves with its outer steps: local reduction, proof, fold."""

    def run(leaves_pdf: pd.DataFrame, outer_pdf: pd.DataFrame) -> pd.DataFrame:
        leaves_pdf = leaves_pdf.sort_values("idx")
        places = leaves_pdf["idx"].tolist()
        n = int(leaves_pdf["n"].iloc[0])
        _, sides, sibs = reduce_block(places, leaves_pdf["leaf"].tolist(), n, BITS)
        up = outer_pdf.iloc[0]
        proofs, folded = [], []
        for tampered, s, p in zip(leaves_pdf["tampered"], sides, sibs):
            all_sides, all_sibs = s + up["sides"], p + up["sibs"]
            proofs.append(_h(all_sibs))
            folded.append(fold(tampered, all_sides, all_sibs))
        return pd.DataFrame({
            "doc_id": leaves_pdf["doc_id"].astype("Int64"), "leaf": leaves_pdf["leaf"].tolist(),
            "subroot": up["subroot"], "root": up["root"], "proof_sha256": proofs,
            "folded_root": folded, "verified": [f == up["root"] for f in folded],
        })

    block = F.shiftright("idx", BITS).alias("block")
    left = base.select("g", "idx", "n", "doc_id", "leaf", "tampered").groupBy("g", block)
    right = outer.groupBy("g", "block")
    return left.cogroup(right).applyInPandas(
        run,
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean",
    )
