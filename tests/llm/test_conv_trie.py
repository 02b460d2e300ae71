"""The conversation trie against a plain Python trie of the rebuilt conversations."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

from callshelf.llm.conv_trie import conversation_trie


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is None:
            continue
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(math.fmod(c, 5)), [])
        rebuilt[c] = base[:h] + turns[h:]
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def subtree(key):
        leaves = 0 if children.get(key) else 1
        saved = (len(nodes[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        for child in children.get(key, []):
            child_leaves, child_saved = subtree(child)
            leaves, saved = leaves + child_leaves, saved + child_saved
        return leaves, saved

    out = set()
    for key, members in nodes.items():
        leaves, saved = subtree(key)
        ends = sorted(c for c in members if len(rebuilt[c]) == len(key))
        out.add((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
            len(children.get(key, [])), leaves, saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def random_rows(seed, n_convs=60):
    rnd = random.Random(seed)
    texts = ["hi", "hello", "ça va", "", None, "how are you", "x" * 50]
    rows = []
    for c in range(n_convs):
        for t in range(rnd.randint(0, 12)):
            rows.append((c, t if rnd.random() > 0.05 else None, rnd.choice(["user", "assistant", None]),
                         rnd.choice(texts)))
    rows += [rows[3], rows[10], (None, 1, "user", "lost"), (500, 0, "user", "alone")]
    return rows


def test_trie_equals_brute_force(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {tuple(r) for r in conversation_trie(df).collect()}
        assert got == brute(rows)


def test_copies_deep_paths_and_clashing_columns(spark):
    rows = []
    for c in range(0, 200):
        for t in range(3):
            rows.append((c, t, "user", f"same {t}", "extra", 1))
    for t in range(300):
        rows.append((1000, t, "user", f"long {t}", "extra", 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, "
                                     "n_convs string, depth int")
    got = {tuple(r) for r in conversation_trie(df).collect()}
    assert got == brute([r[:4] for r in rows])


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie(empty).count() == 0
    rows = [(7, None, None, None), (7, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in conversation_trie(df).collect()} == brute(rows)
