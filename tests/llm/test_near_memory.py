"""What near-duplicates hand to Python at a time."""

from __future__ import annotations

from callshelf.llm import near_dedup
from callshelf.session import scratch

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_python_steps_take_few_wide_rows_at_a_time(spark, monkeypatch):
    folder = scratch(spark, "batches")
    cut, many = near_dedup.text_slices, 3 * near_dedup.BATCH_ROWS

    def watched(batches, *args):
        def seen():
            for batch in batches:
                # in a worker, so an assertion is what can be seen outside
                assert batch.num_rows <= limit, batch.num_rows
                yield batch

        return cut(seen(), *args)

    limit = near_dedup.BATCH_ROWS
    monkeypatch.setattr(near_dedup, "text_slices", watched)
    docs = spark.range(0, many, 1, 1).selectExpr(
        "id as doc_id", "concat_ws(' ', 'a b c d e f g h i j k l', cast(id div 2 as string)) as text"
    )
    docs.write.parquet(folder)
    before = spark.conf.get(ROWS)
    found = near_dedup.near_duplicates(spark.read.parquet(folder))
    assert spark.conf.get(ROWS) == before
    assert found.count() == many


def test_a_smaller_setting_of_the_session_stays(spark):
    from callshelf.session import small_batches

    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "7")
    try:
        with small_batches(spark, 512):
            assert spark.conf.get(ROWS) == "7"
        assert spark.conf.get(ROWS) == "7"
        spark.conf.set(ROWS, "0")  # no limit
        with small_batches(spark, 512):
            assert spark.conf.get(ROWS) == "512"
    finally:
        spark.conf.set(ROWS, before)
