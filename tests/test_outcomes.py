"""Outcomes against a sequential run over the same entries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from callshelf.operators.outcomes import known_entries, lookup, resolve_outcomes, split_known
from callshelf.operators.upsert import code_winners

SCHEMA = "cid string, code_cid string, path string, line_number int, name string, error string"


def sequential(rows, stored: dict[str, str], bypass: bool):
    """One entry after the other, each commit visible to the next."""
    known, outcomes, codes = dict(stored), {}, {}
    for cid, code_cid, path, line, name, error in sorted(rows, key=lambda r: (r[2], r[3])):
        blank = cid is None or not cid.strip()
        if not blank and cid in known and not bypass:
            outcomes[path, line] = ("duplicate", None)
        elif error:
            outcomes[path, line] = ("error", None)
        else:
            immutable = code_cid if blank else known.setdefault(cid, code_cid)
            outcomes[path, line] = ("uploaded", immutable)
            codes[immutable] = (path, line)
    return outcomes, codes


def random_rows(seed: int, n: int = 300):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(30)] + ["hot"] * 30 + ["", " ", None]
    rows = []
    for i in range(n):
        error = "too long" if rng.random() < 0.4 else None
        path = f"p{rng.randrange(20)}"
        rows.append((rng.choice(keys), f"c{rng.randrange(40)}", path, i, f"n{i}", error))
    rng.shuffle(rows)
    stored = {f"k{i}": f"c{rng.randrange(40)}" for i in range(0, 30, 3)}
    return rows, stored


@pytest.mark.parametrize("bypass", [False, True])
@pytest.mark.parametrize("seed, hot_rows", [(1, 10**6), (2, 5), (3, 1), (4, 50)])
def test_like_a_sequential_run(spark, seed, hot_rows, bypass):
    rows, stored = random_rows(seed)
    expected, codes = sequential(rows, stored, bypass)
    entries = spark.createDataFrame(rows, SCHEMA)
    # stored twice: a look-up must not multiply rows
    metadata = spark.createDataFrame(list(stored.items()) * 2, "cid string, code_cid string")
    resolved = resolve_outcomes(entries, metadata, bypass=bypass, hot_rows=hot_rows, hot_keys=3)
    got = {(r.path, r.line_number): (r.outcome, r.immutable_cid) for r in resolved.collect()}
    assert got == expected
    assert resolved.columns == [*entries.columns, "outcome", "immutable_cid"]
    winners = {r.immutable_cid: (r.path, r.line_number) for r in code_winners(resolved).collect()}
    assert winners == codes


def test_failed_entry_does_not_block(spark):
    rows = [
        ("k", "c1", "a", 1, "x", "too long"),
        ("k", "c2", "a", 2, "y", None),
        ("k", "c3", "b", 1, "z", "too long"),
        ("k", "c4", "b", 2, "w", None),
    ]
    got = resolve_outcomes(spark.createDataFrame(rows, SCHEMA)).orderBy("path", "line_number")
    assert [r.outcome for r in got.collect()] == ["error", "uploaded", "duplicate", "duplicate"]


def test_split_known(spark):
    entries = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, ""), (4, None), (5, "a")], "n int, cid string"
    )
    metadata = spark.createDataFrame([("a", "x"), ("", "y"), ("z", "q")], "cid string, code_cid string")
    known, new = split_known(entries, metadata)
    assert sorted(r.n for r in known.collect()) == [1, 5]
    assert sorted(r.n for r in new.collect()) == [2, 3, 4]
    assert [tuple(r) for r in known_entries(entries, metadata).collect()] == [("a", "x")]


def test_hot_keys_leave_the_shuffle_key(spark):
    """All rows of a frequent key are served by the broadcast, wherever they lie."""
    rows = spark.range(10_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        "id",
    )
    facts = rows.groupBy("k").agg(
        F.struct(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first")).alias("fact")
    )
    got = lookup(rows, facts, "k", ["id"], hot_rows=100, hot_keys=1)
    assert got.count() == 10_000
    assert got.where("fact is null").count() == 0
    assert got.where("k = 'hot' and fact.first = 0 and fact.n_rows = 3334").count() == 3334


def test_rows_without_a_key_are_spread(spark):
    rows = spark.range(0, 4000).select(
        F.when(F.col("id") % 2 == 0, F.lit(" ")).otherwise(F.col("id").cast("string")).alias("cid"),
        F.col("id"),
    )
    facts = rows.where("trim(cid) <> ''").groupBy("cid").agg(F.count(F.lit(1)).alias("n_rows"))
    facts = facts.select("cid", F.struct("n_rows").alias("fact"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = lookup(rows, facts, "cid", ["id"]).where("trim(cid) = ''")
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 1000
