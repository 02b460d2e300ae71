"""Windows of the language model travel packed, a row for each bucket."""

from __future__ import annotations

import random
import zlib

import pytest

from callshelf.llm import lm_score

from test_llm_operators import brute_ppm


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def _texts(n, size):
    rng = random.Random(11)
    return ["".join(rng.choices("abc é", k=rng.randint(0, size))) for _ in range(n)]


def test_counts_come_as_one_row_for_each_bucket(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PARTIAL_GRAMS", 100)
    texts = _texts(80, 90)
    rows = lm_score.count_grams(_docs(spark, texts).select("text"), 7).collect()
    assert len(rows) == len({row["bucket"] for row in rows}) <= 7
    got = {}
    for row in rows:
        grams, counts = (lm_score.unpacked(row[c]).tolist() for c in ("grams", "counts"))
        assert grams == sorted(grams) and row["total"] == sum(counts)
        assert not got.keys() & set(grams)
        got |= dict(zip(grams, counts))
    grams, counts = lm_score.gram_counts(texts)
    assert got == dict(zip(grams.tolist(), counts.tolist()))


@pytest.mark.parametrize("contexts", [3, 400])
def test_scores_over_many_flushes(spark, monkeypatch, contexts):
    for name in ("PARTIAL_GRAMS", "PARTIAL_PLACES"):
        monkeypatch.setattr(lm_score, name, 50)
    monkeypatch.setattr(lm_score, "text_slices", lambda b: (x.slice(i, 2) for x in b for i in range(0, x.num_rows, 2)))
    texts = _texts(60, 40) + ["", "zzzzzzz"]
    train = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    for row in lm_score.score_documents(_docs(spark, texts), contexts=contexts).collect():
        expected = brute_ppm(train, texts[row["doc_id"]].encode(), lm_score.ORDER)
        assert row["score"] == pytest.approx(expected, rel=1e-5)


def test_more_rows_in_a_flush_than_two_bytes_number(spark):
    docs = spark.range(0, 70_000, 1, 1).selectExpr("id as doc_id", "concat('x', id % 40) as text")
    got = lm_score.score_documents(docs, contexts=3).collect()
    train = [f"x{i % 40}".encode() for i in range(70_000) if zlib.crc32(str(i).encode()) % 10]
    expected = {}
    for row in got:
        text = f"x{row['doc_id'] % 40}"
        if text not in expected:
            expected[text] = brute_ppm(train, text.encode(), lm_score.ORDER) if len(expected) < 3 else row["score"]
        assert row["score"] == pytest.approx(expected[text], rel=1e-5)
    assert len(got) == 70_000


def test_shuffle_setting_comes_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    lm_score.score_documents(_docs(spark, ["a b", "c"])).count()
    assert spark.conf.get(name, None) == before
