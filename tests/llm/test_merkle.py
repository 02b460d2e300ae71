"""The Merkle manifest against a plain Python tree, and proofs that fold back."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from callshelf.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join(enc(v) for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Levels of a list of digests, and per place its (side, sibling) steps."""
    steps = [[] for _ in nodes]
    places = list(range(len(nodes)))
    level = list(nodes)
    while len(level) > 1:
        for m, a in enumerate(places):
            if a % 2:
                steps[m].append(("R", level[a - 1]))
            elif a + 1 < len(level):
                steps[m].append(("L", level[a + 1]))
            else:
                steps[m].append(("S", None))
        level = [h("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
        places = [a // 2 for a in places]
    return level[0], steps


def fold(d, steps):
    for side, sib in steps:
        d = h(d + sib) if side == "L" else h(sib + d) if side == "R" else h(d)
    return d


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    order = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    subs, lang_steps = {}, {}
    per_row = []
    for g in order:
        group = sorted(by_lang[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        digests = [leaf(*r) for r in group]
        sub, steps = tree(digests)
        subs[g] = sub
        per_row += [(g, r, d, s) for r, d, s in zip(group, digests, steps)]
    root, top_steps = tree([subs[g] for g in order])
    out = []
    for g, r, d, s in per_row:
        path = s + top_steps[order.index(g)]
        tampered = r
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0 and r[3] is not None:
            tampered = (r[0], r[1], r[2], r[3] + 1, r[4])
        folded = fold(leaf(*tampered), path)
        proof = h("".join(sib for _, sib in path if sib is not None))
        out.append((r[0], d, subs[g], root, proof, folded, folded == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(seed, n):
    rnd = random.Random(seed)
    langs = ["en", "fr", None, "zh", "é"]
    return [
        (i if rnd.random() > 0.02 else None, rnd.choice(["a", None]), rnd.choice(langs),
         rnd.choice([5, None, 12]), rnd.choice(["text", "", None, "long " * 100, "日本"]))
        for i in range(n)
    ]


@pytest.mark.parametrize("n, bits", [(1, 10), (2, 10), (3, 2), (37, 2), (300, 3)])
def test_manifest_equals_brute_force(spark, monkeypatch, n, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = rows_of(n, n)
    rows += rows[:2]  # repeated rows are separate leaves
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in merkle.merkle_manifest(df).collect()), key=repr)
    assert got == brute(rows)


def test_one_hot_language_over_many_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", 1)
    rows = [(i, "s", "en" if i % 3 else None, i, f"t{i}") for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = sorted((tuple(r) for r in merkle.merkle_manifest(df).collect()), key=repr)
    assert got == brute(rows)
    tampered = [r for r in got if not r[6]]
    assert tampered and all(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in tampered)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.merkle_manifest(empty).count() == 0
    df = spark.createDataFrame([(1, "s", "en", 3, "abc", "x", 9)], SCHEMA + ", g string, idx long")
    got = [tuple(r) for r in merkle.merkle_manifest(df).collect()]
    assert got == brute([(1, "s", "en", 3, "abc")])
