"""keep_one_of_each against a plain Python version, row by row."""

from __future__ import annotations

import re
import tracemalloc

from callshelf.llm.near_dedup import keep_one_of_each, shingle_sets

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) >= 5:
        return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows):
    """Groups of rows of which exactly one stays; rows equal in all columns count once."""
    sets = [shingles(t) for _, t in rows]
    vertex = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            vertex[s] = min(vertex.get(s, i), i)
    parent = {}

    def find(v):
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    classes = [s for s in set(sets) if s]
    for a in classes:
        for b in classes:
            if a != b and 100 * len(a & b) >= 75 * len(a | b) and a in vertex and b in vertex:
                ra, rb = find(vertex[a]), find(vertex[b])
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
    comps = {}
    for v in set(vertex.values()):
        comps.setdefault(find(v), []).append(v)
    least = {r: min(vs) for r, vs in comps.items()}
    groups = {}
    for (i, t), s in zip(rows, sets):
        comp = least[find(vertex[s])] if s in vertex else None
        if not s or comp is None:
            groups.setdefault(("row", i, t), set()).add((i, t))
        elif i == comp:
            groups.setdefault(("component", comp), set()).add((i, t))
    return list(groups.values())


def check(got, groups):
    """Each group gives one row of its own, and nothing else is there."""
    assert len(got) == len(groups)
    assert all(sum(row in group for row in got) == 1 for group in groups)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return sorted(((r["doc_id"], r["text"]) for r in keep_one_of_each(df).collect()), key=repr)


A = "one two three four five six seven eight nine ten"
A2 = "one two three four five six seven eight nine ten eleven"
B = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_one_id_with_two_texts_keeps_both(spark):
    rows = [(5, A), (7, A), (5, B), (3, B)]
    assert run(spark, rows) == [(3, B), (5, A)]
    check(run(spark, rows), brute(rows))


def test_copies_nulls_and_empty_texts(spark):
    rows = [(1, A), (1, A), (2, A2), (4, A2), (None, A), (None, "x y"), (None, "x y"),
            (8, None), (8, ""), (9, "   "), (6, B.upper()), (6, B), (10, "short text")]
    check(run(spark, rows), brute(rows))


def test_extra_and_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, A, "x", 0), (2, A, "y", 1)],
                               "doc_id long, text string, _row string, kept int").coalesce(1)
    assert [tuple(r) for r in keep_one_of_each(df).collect()] == [(1, A, "x", 0)]


def test_words_of_earlier_texts_are_not_kept():
    """A Python worker holds the words of the texts at hand, not those of all texts so far."""
    def seen(i):
        shingle_sets([" ".join(f"word{i}-{j}" for j in range(20_000))])
        return tracemalloc.get_traced_memory()[0]

    tracemalloc.start()
    held = [seen(i) for i in range(5)]
    tracemalloc.stop()
    assert held[-1] - held[0] < 1_000_000
