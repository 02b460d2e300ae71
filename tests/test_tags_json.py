"""Exact JSON text of tags, as Python's json.dumps writes it."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from callshelf.functions.paths import tags_json_text


def test_same_text_as_json_dumps(spark):
    lists = [
        ["a", "b"], [], ["größe", "日本", "😀x", 'q"uote', "back\\slash", "tab\tnew\nline\r",
                         "\b\f\x01\x1f\x7f", "/", "~ "],
        ["𝄞", "é" * 3], [None, "x"],
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)] + [(99, None)],
                               "n int, tags array<string>")
    got = dict(df.select("n", tags_json_text(F.col("tags"))).collect())
    assert got == {**{i: json.dumps(v) for i, v in enumerate(lists)}, 99: None}


def test_marks_within_items(spark):
    """Items that look like what stands between items, like null or like an escape."""
    lists = [
        ["null", None, "", None], [None], [""], ["", ""], ['", "', ",", '"', '"null"'],
        ["\\u0041", "\\", "\\\\", '\\"'], ["\x00\x01\x02", "\u2028\ufeff\uffff", "ÿþ"], [" \x7f"],
        ["x" * 70_000 + "é" * 70_000 + "😀", '"' * 70_000],
    ]
    df = spark.createDataFrame(list(enumerate(lists)), "n int, tags array<string>")
    got = dict(df.select("n", tags_json_text(F.col("tags"))).collect())
    assert got == {i: json.dumps(v) for i, v in enumerate(lists)}


def test_bytes_that_are_no_utf8(spark):
    df = spark.sql("SELECT array(CAST(X'61FF62' AS STRING), CAST(X'FE' AS STRING), NULL) AS tags")
    assert df.select(tags_json_text(F.col("tags"))).first()[0] == (
        '["a\\ufffdb", "\\ufffd", null]')


def test_no_work_for_each_character(spark):
    """Characters are no array of their own: the cost of a call for each was 3 µs."""
    df = spark.range(1).select(tags_json_text(F.array(F.lit("a"), F.col("id").cast("string"))))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"regexp_extract_all\([^,]*, \(\?s\)\.,", plan)
