"""What happens to each entry of a run: uploaded, duplicate or error.

Entries are taken in order. An entry whose key is already in the catalog, or was
uploaded by an earlier entry of the run, is a duplicate. An entry that does not fit is
an error and does not block a later one.

A group of equal keys may hold a third of all rows, so no window runs over a group.
Each group shrinks (map-side first) to one fact row, which rows then look up. The most
frequent keys are looked up in a bounded broadcast and their rows leave the shuffle
key; only the others meet in a shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPLOADED, DUPLICATE, ERROR = "uploaded", "duplicate", "error"

ORDER = ("path", "line_number")
# The place of an entry in a run. Sources that came later go after earlier ones; several
# contents of one path that came together go in the order of their hashes; ``row`` is a
# number of the staged table and decides between rows that are equal.
POSITION = ("arrival", "path", "twin", "line_number", "row")

# At most this many keys are broadcast. Any key beyond them holds less than 1/HOT_KEYS
# of all rows, so what is left for the shuffle join is spread evenly enough.
HOT_KEYS = 5_000
# Keys with fewer rows never count as frequent.
HOT_ROWS = 100_000


def has_key(key: str) -> Column:
    """A blank key is like no key: never known, never shared."""
    return F.col(key).isNotNull() & (F.trim(F.col(key)) != "")


def known_entries(keys: DataFrame, metadata: DataFrame, key: str = "cid") -> DataFrame:
    """``(key, known_code_cid)`` of those catalog rows whose key occurs in ``keys``.

    The catalog is the left side of the semi join: with few new keys Spark broadcasts
    them and the catalog is filtered where it is read.
    """
    wanted = keys.where(has_key(key)).select(key)
    return (
        metadata.select("cid", "code_cid")
        .withColumnRenamed("cid", key)
        .join(wanted, key, "left_semi")
        .groupBy(key)
        .agg(F.min("code_cid").alias("known_code_cid"))
    )


def lookup(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    spread: Sequence[str],
    *,
    hot_rows: int = HOT_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """``rows`` left-joined with ``facts(key, fact)``, safe for frequent keys.

    ``fact`` is a struct with ``n_rows`` among its fields (so both uses of ``facts`` ask
    for the same columns and share one shuffle); it is null where nothing matches.
    """
    hot = (
        facts.where(F.col("fact.n_rows") >= hot_rows)
        .orderBy(F.desc("fact.n_rows"), key)
        .limit(hot_keys)
        .select(F.col(key).alias("_hot_key"), F.col("fact").alias("_hot_fact"))
    )
    cold = facts.select(F.col(key).alias("_cold_key"), F.col("fact").alias("_cold_fact"))
    # A row served by the broadcast gets a shuffle key of its own that matches nothing.
    # So does a row without a key: such rows may be many.
    own = F.concat(F.lit("\0"), F.xxhash64(*spread).cast("string"))
    shuffle_key = F.when(F.col("_hot_fact").isNull() & has_key(key), F.col(key)).otherwise(own)
    return (
        rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_shuffle_key", shuffle_key)
        .join(cold, F.col("_shuffle_key") == F.col("_cold_key"), "left")
        .withColumn("fact", F.coalesce("_hot_fact", "_cold_fact"))
        .drop("_hot_key", "_hot_fact", "_shuffle_key", "_cold_key", "_cold_fact")
    )


def mark_known(
    entries: DataFrame,
    metadata: DataFrame,
    key: str = "cid",
    *,
    spread: Sequence[str] | None = None,
    **hot: int,
) -> DataFrame:
    """Adds ``known``: does the catalog have the entry's key?"""
    sizes = (
        entries.where(has_key(key))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    facts = sizes.join(known_entries(sizes, metadata, key), key).select(
        key, F.struct("n_rows", "known_code_cid").alias("fact")
    )
    marked = lookup(entries, facts, key, spread or entries.columns, **hot)
    return marked.withColumn("known", F.col("fact").isNotNull()).drop("fact")


def split_known(
    entries: DataFrame, metadata: DataFrame, key: str = "cid", **options
) -> tuple[DataFrame, DataFrame]:
    """``(known, new)``: entries with and without a catalog row."""
    marked = mark_known(entries, metadata, key, **options)
    return marked.where("known").drop("known"), marked.where("NOT known").drop("known")


def resolve_outcomes(
    entries: DataFrame,
    metadata: DataFrame | None = None,
    *,
    bypass: bool = False,
    key: str = "cid",
    order: Sequence[str] = ORDER,
    hot_rows: int = HOT_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Adds ``outcome`` and ``immutable_cid`` to ``entries(key, code_cid, error, *order)``.

    ``immutable_cid`` is the code id the entry is stored under: the catalog's, else that
    of the first fitting entry of the key. With ``bypass`` known entries are uploaded
    again. ``entries`` is read twice, so hand in a table, not a computation.
    """
    fits = F.col("error").isNull()
    position = F.struct(*order)
    facts = (
        entries.where(has_key(key))
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min(F.when(fits, F.struct(position.alias("at"), F.col("code_cid")))).alias("first"),
        )
    )
    if metadata is None:
        facts = facts.withColumn("known_code_cid", F.lit(None).cast("string"))
    else:
        facts = facts.join(known_entries(facts, metadata, key), key, "left")
    facts = facts.select(
        key,
        F.struct(
            F.col("n_rows"),
            F.col("first.at").alias("first_at"),
            F.col("known_code_cid"),
            F.coalesce("known_code_cid", "first.code_cid").alias("immutable_cid"),
        ).alias("fact"),
    )
    looked_up = lookup(entries, facts, key, order, hot_rows=hot_rows, hot_keys=hot_keys)

    taken = F.col("fact.known_code_cid").isNotNull() | F.coalesce(
        position > F.col("fact.first_at"), F.lit(False)
    )
    outcome = F.when(~fits, ERROR).otherwise(UPLOADED)
    if not bypass:
        outcome = F.when(taken, DUPLICATE).otherwise(outcome)
    return (
        looked_up.withColumn("outcome", outcome)
        .withColumn(
            "immutable_cid",
            F.when(
                F.col("outcome") == UPLOADED, F.coalesce("fact.immutable_cid", F.col("code_cid"))
            ),
        )
        .drop("fact")
    )
