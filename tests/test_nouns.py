"""The learned noun guesser: counts, back-off over endings, and the tags it keeps."""

from __future__ import annotations

import pytest

from callshelf.operators import nouns
from callshelf.operators.tags import without_words
from check import compare, duck
from callshelf.plans.oracles import ORACLES
from callshelf.plans.queries import QUERIES

CORPUS = [
    ("The station has a parser. The nation runs fast. It runs and eats.", "en"),
    ("A creation of the parser eats 3 tokens. We run, we eat, they run.", "en"),
    ("Der Vertrag und die Station laufen. Sie laufen schnell mit Paris.", "de"),
    ("La nation et la station marchent.", "fr"),
    (None, "en"),
    ("", None),
]


@pytest.fixture()
def model(spark):
    docs = spark.createDataFrame(CORPUS, "text string, lang string")
    return nouns.learn(docs)


def test_counts(spark, model):
    words = {r["word"]: (r["n"], r["c"]) for r in model.words.collect()}
    assert words["parser"] == (2, 2)           # after "a" and "the"
    assert words["runs"] == (2, 0)
    assert words["paris"] == (1, 1)            # a capital inside a sentence
    assert words["tokens"] == (1, 1)           # after a number
    assert words["station"] == (3, 3)          # articles of English, German and French
    assert "." not in words and "3" not in words


def test_back_off_for_unseen_words(spark, model):
    asked = spark.createDataFrame([("formation",), ("runs",), ("station",), (None,), ("",)], "word string")
    got = {r["word"]: (r["p"], r["noun"]) for r in nouns.estimates(model, asked).collect()}
    assert got["station"][1] and got["formation"][1]  # unseen, ends like station and nation
    assert not got["runs"][1]
    assert None not in got and got[""][1] is False
    rate = sum(c for _, c in [(r["n"], r["c"]) for r in model.words.collect()]) / sum(
        r["n"] for r in model.words.collect())
    assert got["formation"][0] > rate > got["runs"][0]


def test_tags_keep_nouns(spark, model):
    tagged = spark.createDataFrame([(1, ["parser", "runs", "station"]), (2, [])],
                                   "page_id long, tags array<string>")
    kept = without_words(tagged, nouns.non_nouns(model, tagged), key="page_id")
    assert {r["page_id"]: r["tags"] for r in kept.collect()} == {1: ["parser", "station"], 2: []}


def test_empty_corpus_calls_nothing_a_noun(spark):
    empty = nouns.learn(spark.createDataFrame([], "text string, lang string"))
    asked = spark.createDataFrame([("station",)], "word string")
    assert [tuple(r) for r in nouns.estimates(empty, asked).collect()] == [("station", None, False)]


@pytest.mark.parametrize("name", ["q_noun_estimates", "q_noun_tags"])
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), sf, QUERIES[name], ORACLES[name]) is None


def test_ingest_with_a_learned_model(spark, store, sources, model):
    from datetime import datetime, timezone

    from callshelf.plans.ingest import ingest

    files = {"/w/station_parser/runs.py": 'def f(x):\n    """Doc."""\n    return x\n'}
    run = ingest(sources(files), store, base="/w", as_of=datetime(2024, 1, 1, tzinfo=timezone.utc),
                 words=model)
    run.release()
    assert [list(r["tags"]) for r in store.metadata().collect()] == [["parser", "station"]]


def test_corpus_is_read_once(spark, monkeypatch):
    """The endings are counted from the staged words, and a text is cut once for all uses."""
    plans = {}

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stage(df, name)

    stage = nouns.stage
    monkeypatch.setattr(nouns, "stage", recorded)
    nouns.learn(spark.createDataFrame(CORPUS, "text string, lang string"))
    assert plans["noun-words"].count("regexp_extract_all") == 1
    assert "regexp_extract_all" not in plans["noun-endings"]


def test_places_of_odd_tokens(spark):
    """Numbers, marks and letters outside ASCII are told apart as their patterns do."""
    texts = ["0 ape ! Bee ? Cow . Dog 9 elk", "\u0660 \u00e9l \u00c9l \U00010400x", "7", "", None, "a.b!c?d1e"]
    docs = spark.createDataFrame([(t, None) for t in texts], "text string, lang string")
    got = sorted(tuple(r) for r in nouns.word_places(docs).collect())
    assert got == sorted([
        ("ape", 1), ("bee", 0), ("cow", 0), ("dog", 0), ("elk", 1), ("\u00e9l", 0), ("\u00e9l", 1),
        ("\U00010428x", 1), ("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 1)])
