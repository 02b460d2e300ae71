from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from callshelf.functions.paths import is_test, path_tags, stored_path, tags_json
from callshelf.operators.tags import tag_counts, without_words


def test_stored_path(spark):
    df = spark.createDataFrame([("/a/b.py",), ("a\\b.py",), ("//a/b.py",)], "p string")
    got = [r[0] for r in df.select(stored_path(F.col("p"))).collect()]
    assert got == ["a/b.py", "a/b.py", "a/b.py"]


@pytest.mark.parametrize(
    "name, path, expected",
    [
        ("test_x", "/a/b.py", True),
        ("x_test", "/a/b.py", True),
        ("testing", "/a/b.py", False),
        ("x", "/tests/b.py", True),
        ("x", "/a/test/c/b.py", True),
        ("x", "/a/Tests/b.py", False),
        ("x", "/a/test.py", False),
        ("x", "/a/test", True),
        ("x", "/contest/b.py", False),
    ],
)
def test_is_test(spark, name, path, expected):
    row = spark.range(1).select(is_test(F.lit(name), F.lit(path))).first()
    assert row[0] is expected


TAG_CASES = [
    ("/work/project/billing_api/user-data.py", "/work", ["api", "billing", "data", "project", "user"]),
    ("/work/src/lib/utils.py", "/work", ["utils"]),
    ("/work/SRC/Models/Order.py", "/work", ["models", "order"]),
    ("/elsewhere/x/y.py", "/work", ["elsewhere", "x", "y"]),
    ("/work/.hidden/~tmp/a_b.py", "/work", ["b"]),
    ("/work/__init__.py", "/work", ["init"]),
    ("/work/up-and-down/down.py", "/work", ["down"]),
    ("/work/v2/2024/_9.py", "/work", ["v2"]),
    ("/workshop/a1.py", "/work", ["a1", "workshop"]),
    ("/work/a.py/b.pyc", "/work", ["b.pyc"]),
]


@pytest.mark.parametrize("path, base, expected", TAG_CASES)
def test_path_tags(spark, path, base, expected):
    assert spark.range(1).select(path_tags(F.lit(path), base)).first()[0] == expected


def test_path_tags_options(spark):
    tags = path_tags(F.lit("/home/ann/Team/x.py"), "/", drop=["team"], home_name="ann")
    assert spark.range(1).select(tags).first()[0] == ["x"]


def test_tags_json_round_trip(spark):
    lists = [["special-chars", "with spaces", "unicode:测试", 'quote"'], []]
    df = spark.createDataFrame([(t,) for t in lists], "tags array<string>")
    texts = [r[0] for r in df.select(tags_json(F.col("tags"))).collect()]
    assert [json.loads(t) for t in texts] == lists
    assert texts[1] == "[]"


def test_word_list_and_counts(spark):
    tagged = spark.createDataFrame(
        [("a", ["fast", "parser"]), ("b", ["fast"]), ("c", [])], "path string, tags array<string>"
    )
    words = spark.createDataFrame([("Fast",), ("slow",)], "word string")
    got = {r.path: r.tags for r in without_words(tagged, words).collect()}
    assert got == {"a": ["parser"], "b": [], "c": []}
    assert {tuple(r) for r in tag_counts(tagged).collect()} == {("fast", 2), ("parser", 1)}
