from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from callshelf.schemas import CODES, COMMITS, METADATA
from callshelf.session import scratch
from callshelf.sources.store import CatalogStore

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def codes(spark, *rows):
    return spark.createDataFrame([(c, v, "s", "d", "x", t, t) for c, v, t in rows], CODES)


def metadata(spark, *rows):
    values = [(c, code, name, "function", False, "p", ["t"]) for c, code, name in rows]
    return spark.createDataFrame(values, METADATA)


def test_empty(spark, store):
    store.require_tables()
    assert store.codes().count() == store.metadata().count() == 0
    assert store.codes().schema.fieldNames() == CODES.fieldNames()
    assert store.total().first().total == 0
    # setting up twice keeps what is there
    store.commit(codes(spark, ("a", "a", T1)), metadata(spark, ("m", "a", "f")))
    assert CatalogStore.create(spark, store.root).total().first().total == 1


def test_newest_version_counts(spark, store):
    store.commit(
        codes(spark, ("a", "a", T1), ("b", "b", T1)),
        metadata(spark, ("m", "a", "old"), ("n", "b", "f")),
    )
    store.commit(codes(spark, ("a", "a2", T2)), metadata(spark, ("m", "a", "new")))
    store.commit(codes(spark, ("c", "c", T2)), metadata(spark))
    assert {(r.cid, r.version_cid, r.created_at) for r in store.codes().collect()} == {
        ("a", "a2", T2), ("b", "b", T1), ("c", "c", T2),
    }
    assert {(r.cid, r.code_name) for r in store.metadata().collect()} == {("m", "new"), ("n", "f")}
    assert store.total().first().total == 3
    assert {(r.cid, r.version_cid) for r in store.catalog().collect()} == {("m", "a2"), ("n", "b")}

    before = {tuple(r) for r in store.codes().select("cid", "version_cid").collect()}
    exported = {r.cid: r.tags for r in store.metadata_export().collect()}
    assert exported == {"m": '["t"]', "n": '["t"]'}
    store.compact()
    assert store._versions() == [4]
    assert {tuple(r) for r in store.codes().select("cid", "version_cid").collect()} == before


def test_both_tables_or_none(spark, store):
    store.commit(codes(spark, ("a", "a", T1)), metadata(spark, ("m", "a", "f")))
    fails = metadata(spark, ("n", "b", "f")).withColumn(
        "code_name", F.raise_error(F.lit("no disk")).cast("string")
    )
    with pytest.raises(Exception, match="no disk"):
        store.commit(codes(spark, ("b", "b", T2)), fails)
    assert store.total().first().total == 1
    assert [r.cid for r in store.metadata().collect()] == ["m"]
    # the next run takes the number of the one that died
    assert store.commit(codes(spark, ("c", "c", T2)), metadata(spark, ("o", "c", "f"))) == 2
    assert {r.cid for r in store.codes().collect()} == {"a", "c"}


def test_a_change_may_read_the_catalog(spark, store):
    store.commit(codes(spark, ("a", "a", T1)), metadata(spark, ("m", "a", "f")))
    renamed = store.metadata().withColumn("code_name", F.lit("g"))
    store.commit(store.codes(), renamed)
    assert [r.code_name for r in store.metadata().collect()] == ["g"]


def test_missing_tables(spark, store):
    with pytest.raises(RuntimeError, match="No catalog"):
        CatalogStore(spark, scratch(spark, "nothing")).require_tables()
    lame = CatalogStore(spark, scratch(spark, "lame"))
    spark.createDataFrame([(0, True, None, "0", None)], COMMITS).write.parquet(
        f"{lame.root}/commits"
    )
    spark.createDataFrame([], CODES).write.parquet(f"{lame.root}/codes/v=0")
    with pytest.raises(RuntimeError, match="no table 'metadata'"):
        lame.require_tables()
    spark.createDataFrame([], METADATA.fieldNames()[0] + " string").write.parquet(
        f"{lame.root}/metadata/v=0"
    )
    with pytest.raises(RuntimeError, match="does not have the columns.*code_cid"):
        lame.require_tables()


def test_two_writers_from_one_version_keep_both(spark, store):
    seen = store.runs()
    store.commit(codes(spark, ("a", "a", T1)), metadata(spark, ("m", "a", "f")), runs=seen)
    store.commit(codes(spark, ("b", "b", T1)), metadata(spark, ("n", "b", "g")), runs=seen)
    assert {r.cid for r in store.codes().collect()} == {"a", "b"}
    assert store._versions() == [0, 1, 1]
    # a commit that was under way while the catalog was compacted is not lost either
    store.compact()
    store.commit(codes(spark, ("c", "c", T1)), metadata(spark, ("o", "c", "h")), runs=seen)
    assert {r.cid for r in store.codes().collect()} == {"a", "b", "c"}


def test_tables_without_a_ledger_are_not_taken_over(spark):
    root = scratch(spark, "lost")
    codes(spark, ("a", "a", T1)).write.parquet(f"{root}/codes/v=0")
    with pytest.raises(RuntimeError, match="no commits"):
        CatalogStore.create(spark, root)


def test_batches(spark, store):
    assert not store.has_batch("s#1")
    store.commit(codes(spark), metadata(spark), batch_id="s#1")
    assert store.has_batch("s#1") and not store.has_batch("s#2")
