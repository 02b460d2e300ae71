"""What the plans must look like: pruned scans, no needless shuffles."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from callshelf.operators import report
from callshelf.operators.entries import annotate, catalog_entries, file_errors
from callshelf.operators.extract import extract_callables
from callshelf.operators.outcomes import POSITION, known_entries, resolve_outcomes
from callshelf.operators.upsert import codes_changes, metadata_changes
from callshelf.plans import queries
from callshelf.session import stage

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(plan: str) -> list[set[str]]:
    """Columns of each scan, from its ``ReadSchema``."""
    schemas = re.findall(r"ReadSchema: struct<(.*?)>\n", plan + "\n")
    return [set(re.findall(r"(\w+):", schema)) for schema in schemas]


@pytest.fixture(scope="module")
def staged(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    corpus = queries.part_corpus(spark, SF_DIR)
    return stage(annotate(extract_callables(corpus)), "annotated")


def test_extraction_moves_no_contents(spark, sources):
    plan = plan_of(annotate(extract_callables(stage(sources({"/a.py": "x = 1"}), "in"))))
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_outcomes_read_no_texts(spark, staged, store):
    entries = catalog_entries(staged)
    plan = plan_of(resolve_outcomes(entries.drop("signature", "docstring", "source_code"),
                                    store.metadata_keys()))
    scans = read_columns(plan)
    assert scans and all(not c & {"source_code", "docstring", "signature"} for c in scans)
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_catalog_look_up_reads_two_columns(spark, staged, store):
    plan = plan_of(known_entries(catalog_entries(staged), store.metadata_keys()))
    assert {"cid", "code_cid"} in read_columns(plan)
    # few new keys: they are broadcast and the catalog stays where it is read
    assert "BroadcastHashJoin [cid" in plan and "LeftSemi" in plan


def test_metadata_of_a_plain_run_needs_no_shuffle(spark, staged):
    outcomes = stage(resolve_outcomes(catalog_entries(staged)), "outcomes")
    assert "Exchange" not in plan_of(metadata_changes(outcomes, one_per_key=True))
    plain, grouped = (
        sorted(metadata_changes(outcomes, one_per_key=one).collect()) for one in (True, False)
    )
    assert plain == grouped and plain


def test_compacted_catalog_is_read_without_shuffle(spark, store):
    store.commit(store.codes(), store.metadata())
    assert "Exchange" in plan_of(store.codes())
    store.compact()
    assert "Exchange" not in plan_of(store.codes())


@pytest.mark.parametrize(
    "name, columns",
    [
        ("q_content_cid", {"doc_id", "text"}),
        ("q_path_tags", {"page_id", "url"}),
        ("q_tag_counts", {"url"}),
        ("q_scan_exclude", {"url"}),
        ("q_signatures", {"p_partkey", "p_name", "p_brand", "p_size"}),
        ("q_extract_documents", {"doc_id", "text", "lang", "source"}),
    ],
)
def test_scans_are_pruned(spark, name, columns):
    assert read_columns(plan_of(queries.QUERIES[name](spark, SF_DIR))) == [columns]


def test_no_operator_of_a_run_crosses_tables(spark, staged, store):
    entries = catalog_entries(staged.withColumn("row", F.monotonically_increasing_id()))
    entries = stage(entries, "entries")
    outcomes = stage(resolve_outcomes(entries, order=POSITION), "outcomes")
    stats = report.run_stats(staged, outcomes)
    failed, rejected = file_errors(staged), report.upload_errors(outcomes)
    frames = [
        codes_changes(outcomes, entries, datetime(2024, 1, 1)),
        metadata_changes(outcomes, order=POSITION),
        stats, report.run_status(stats),
        report.error_report(failed, rejected),
        report.preview(entries, store.metadata_keys()),
        store.catalog(), store.total(),
    ]
    for frame in frames:
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_texts_of_few_winners_stay_where_they_are(spark, staged):
    entries = catalog_entries(staged.withColumn("row", F.monotonically_increasing_id()))
    entries = stage(entries, "entries")
    outcomes = stage(resolve_outcomes(entries, order=POSITION), "outcomes")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(codes_changes(outcomes, entries, datetime(2024, 1, 1)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [row" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_query_crosses_tables(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
