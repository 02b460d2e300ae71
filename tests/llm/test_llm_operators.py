"""Each operator against a brute-force version, and on odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from callshelf.llm import bpe, lm_score, near_dedup, packing, quality, sharding, surrogates, topk
from callshelf.llm import toxicity, url_filter

SYLLABLES = "the th er on an re he in ed nd ha at en es of or nt ea ti to".split()
ODD = [None, "", " \n\t ", "one", "One two three", "x" * 40_000, "wörd " * 300, "a\x1cb \u2003 c"]


def texts(seed: int, n: int, least: int = 5, most: int = 120) -> list[str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 3)))
    return [" ".join(word() for _ in range(rng.randint(least, most))) for _ in range(n)]


def near_copies(seed: int, base: str, n: int) -> list[str]:
    rng, copies = random.Random(seed), []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(SYLLABLES) + "x"
        copies.append(" ".join(words))
    return copies


@pytest.fixture(scope="module")
def documents(spark):
    """``documents(texts)``: a table with clashing names beside the usual columns."""

    def build(rows, ids=None):
        data = [
            (i, text, ["en", "de", None][i % 3], f"s{i % 2}", 1, "x", 2)
            for i, text in zip(ids or range(len(rows)), rows)
        ]
        return spark.createDataFrame(
            data,
            "doc_id long, text string, lang string, source string,"
            " _counts int, _map string, _features int",
        )

    return build


# -- 1 sharding -------------------------------------------------------------------------


def test_differencing_is_tight_and_complete():
    rng = random.Random(1)
    for n in (0, 1, 5, 200):
        sizes = [rng.randint(1, 10_000) for _ in range(n)]
        parts = sharding.differencing(sizes, 8)
        assert len(parts) == n and set(parts) <= set(range(8))
    assert sharding.spread(np.array(sizes), np.array(parts), 8) <= 50


def test_shards_keep_groups_and_number_rows(documents):
    rows = texts(2, 120) + ["same"] * 60 + ODD * 2
    got = sharding.shard_documents(documents(rows)).toPandas()
    assert len(got) == len(rows)
    own = [(t or "").encode() for t in rows]
    assert (got.sort_values("doc_id")["size"].to_numpy() == [len(t) + 1 for t in own]).all()
    assert (got.sort_values("doc_id")["text_crc32"].to_numpy() == [zlib.crc32(t) for t in own]).all()
    groups = defaultdict(set)
    for i, shard in zip(got["doc_id"], got["shard"]):
        groups[own[i]].add(shard)
        assert 0 <= shard < 8
    assert all(len(shards) == 1 for shards in groups.values())
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    assert sharding.shard_documents(documents([])).count() == 0


# -- 2 LM scores --------------------------------------------------------------------------


def brute_ppm(train: list[bytes], text: bytes, order: int) -> float:
    """One symbol at a time, with explicit sets of excluded symbols; all contexts kept."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    for one in train:
        symbols = [256] * order + list(one) + [256]
        for i in range(order, len(symbols)):
            for k in range(order + 1):
                counts[tuple(symbols[i - k : i])][symbols[i]] += 1
    symbols, total = [256] * order + list(text) + [256], 0.0
    for i in range(order, len(symbols)):
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            context = counts.get(tuple(symbols[i - k : i]))
            if not context:
                continue
            allowed = {s: n for s, n in context.items() if s not in excluded}
            below = sum(allowed.values())
            if symbols[i] in allowed:
                total += math.log10((allowed[symbols[i]] - 0.5) / below)
                break
            if allowed:
                total += math.log10(0.5 * len(allowed) / below)
            excluded |= set(context)
        else:
            total += math.log10(1 / (257 - len(excluded)))
    return total


def test_ppm_against_brute_force(documents):
    rows = texts(3, 40, 1, 15) + [None, "", "ÜX", "zz Zz zz", "zz Zz zz"]
    got = lm_score.score_documents(documents(rows), contexts=1 << 40, hot_words=8).toPandas()
    own = [t or "" for t in rows]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows))]
    train = [t.encode() for t, h in zip(own, held) if not h]
    words = Counter(w for t in train for w in [*t.lower().split(), None])
    total, distinct = sum(words.values()), len(words)
    for row in got.itertuples():
        text = own[row.doc_id].encode()
        tokens = [*text.lower().split(), None]
        base = sum(
            math.log10((words.get(t, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens
        )
        assert row.held_out == held[row.doc_id]
        assert (row.n_tokens, row.train_tokens) == (len(tokens), total)
        assert row.n_known == sum(t in words for t in tokens)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert row.score == pytest.approx(brute_ppm(train, text, lm_score.ORDER), rel=1e-5)


@pytest.mark.parametrize("contexts", [3, 50, 1000])
def test_ppm_uses_contexts_outside_the_trie(documents, contexts):
    rows = texts(5, 60, 1, 15) + [None, "", "ÜX", "zz Zz zz", "aaaaaaaaaaaa", "日本 \x00"] * 3
    got = lm_score.score_documents(documents(rows), contexts=contexts).toPandas()
    own = [(t or "").encode() for t in rows]
    train = [t for i, t in enumerate(own) if zlib.crc32(str(i).encode()) % 10]
    assert len(got) == len(rows) and got["held_out"].any()
    for row in got.itertuples():
        assert row.score == pytest.approx(brute_ppm(train, own[row.doc_id], lm_score.ORDER), rel=1e-5)


def test_ppm_with_default_parameters_on_many_symbols(documents):
    rng = random.Random(6)
    rows = ["".join(rng.choices("abcdefghijklmnop ", k=4_000)) for _ in range(60)]
    got = lm_score.score_documents(documents(rows)).toPandas().set_index("doc_id")
    train = [t.encode() for i, t in enumerate(rows) if zlib.crc32(str(i).encode()) % 10]
    assert sum(map(len, train)) > lm_score.CONTEXTS and got["held_out"].any()
    held = int(got.index[got["held_out"]][0])
    for i in (held, 0 if held else 1):
        assert got["score"][i] == pytest.approx(brute_ppm(train, rows[i].encode(), lm_score.ORDER), rel=1e-5)


@pytest.mark.parametrize("contexts", [3, 100, 1 << 40])
def test_ppm_probabilities_sum_to_one(contexts):
    grams, n = lm_score.gram_counts(texts(4, 30))
    counts = {}
    for k in range(lm_score.ORDER + 1):
        keys = (grams // 257) % 257**k * 257 + grams % 257
        unique, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, weights=n).astype(np.int64)
        _, context = np.unique(unique // 257, return_inverse=True)
        kept = np.bincount(context, weights=sums)[context] * contexts >= n.sum()
        counts[k] = np.column_stack([unique // 257, unique % 257, sums])[kept]
    model = lm_score.Automaton(counts)
    chances = 10.0 ** model.logs.reshape(-1, model.width).astype(float)
    unseen = 257 - (model.width - 1)
    sums = chances[:, :-1].sum(axis=1) + unseen * chances[:, -1]
    assert np.allclose(sums, 1, atol=1e-4)


def test_ppm_without_training_rows(documents):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    row = lm_score.score_documents(documents(["ab", None], ids)).orderBy("doc_id").collect()[0]
    assert row["score"] == pytest.approx(3 * math.log10(1 / 257)) and row["n_known"] == 0
    assert lm_score.score_documents(documents([])).count() == 0


# -- 3 exact top-k -------------------------------------------------------------------------


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.2, (400, 12)).round(3).tolist()
    vectors[7], vectors[9] = vectors[8], vectors[8]  # ties
    vectors[10], vectors[11], vectors[12] = None, [None] * 12, [float("nan")] * 12
    vectors[13], vectors[14], vectors[50] = [float("inf")] * 12, [], [0.0] * 12
    rows = [*enumerate(vectors), (None, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, query_block=3, candidate_block=90).toPandas()
    whole = {
        i: np.floor(256 * np.array(v)).astype(int)
        for i, v in enumerate(vectors)
        if v and None not in v and np.isfinite(v).all()
    }
    for query in (i for i in whole if i % 50 == 0):
        best = sorted((-int(v @ whole[query]), i) for i, v in whole.items() if i != query)[:5]
        own = got[got["query_id"] == query].sort_values("rank")
        assert list(zip(-own["score"], own["vec_id"])) == best
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
    assert set(got["query_id"]) == {i for i in whole if i % 50 == 0}
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


# -- 4 quality ------------------------------------------------------------------------------


def brute_counts(text: str) -> dict:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    found = Counter(windows)
    covered = {j for i, w in enumerate(windows) if found[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_quality_counts_and_verdicts(documents):
    good = [text + ".\n" + text[:8] for text in texts(6, 150, 40, 200)]
    junk = [" ".join(w + "%%%" for w in text.split()) for text in texts(7, 6, 40, 60)]
    rows = good + junk + [text.upper() for text in texts(8, 3, 40, 60)] + ODD + ["a b c d e " * 9]
    got = quality.quality_report(documents(rows)).toPandas().set_index("doc_id").sort_index()
    for i, text in enumerate(rows):
        expected = brute_counts(text or "")
        assert {k: got.loc[i, k] for k in expected} == expected
        n, repeated = expected["n_words"], expected["n_repeat_words"]
        assert got.loc[i, "base_failed"] == (n < 10 or 100 * repeated > 20 * n)
    assert got.loc[: len(good) - 1, "kept"].all()
    assert not got.loc[len(good) :, "kept"].any()
    kept = quality.keep_quality(documents(rows))
    assert kept.columns == documents(rows).columns and kept.count() == len(good)
    assert quality.quality_report(documents([])).count() == 0


# -- 5 near-duplicates ------------------------------------------------------------------------


def brute_components(rows) -> list[int]:
    sets = []
    for text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        windows = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        sets.append(windows if len(words) >= 5 else {tuple(words)} if words else set())
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(rows))]


def test_near_duplicates_against_all_pairs(documents):
    base = texts(9, 3, 60, 60)
    passage = " ".join(texts(10, 1, 20, 20))
    rows = texts(11, 60) + [c for i, b in enumerate(base) for c in near_copies(i, b, 40)]
    rows += [passage + " " + text for text in texts(12, 40, 40, 60)] + ["copy of one text ok"] * 30 + ODD
    expected = brute_components(rows)
    for small in (4, 256):
        got = near_dedup.near_duplicates(documents(rows), small_node=small).toPandas()
        got = got.set_index("doc_id").sort_index()
        assert got["component_id"].tolist() == expected
        assert got["kept"].tolist() == [i == c for i, c in enumerate(expected)]
    kept = near_dedup.keep_one_of_each(documents(rows + ["copy"], [*range(len(rows)), 0]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))
    assert near_dedup.near_duplicates(documents([])).count() == 0


# -- 6 URL rules ---------------------------------------------------------------------------------


def brute_rule(host: str, path: str, rules):
    fits = [
        r for r in rules
        if ("." + host).endswith("." + r.host) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.Example.COM/en/x?q#f", "http://www.example.com/en/",
        "http://x.www.example.com/en/1", "http://example.com", "http://example.com/", "ftp://net/fr/",
        "http://a.net/es/ü", "http://anet/es/", "http://b.net?x=/es/", "http://c.net/de/net/fr/",
        "http://evil.org/a.com/", "x://com/", "http://co m/", "http://a.com\0/en/", "http://é.com/" + "y" * 5000,
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumnRenamed("page_id", "Rule")
    got = {r["url"]: r for r in url_filter.judge_urls(df).collect()}
    for url in urls:
        host, path = url_filter.host_and_path(url)
        best = brute_rule(host, path, url_filter.RULES)
        row = got[url]
        assert (row["host"], row["path"]) == (host, path)
        assert row["rule"] == (best.name if best else None)
        assert row["verdict"] == (best.verdict if best else url_filter.ALLOW)
    many = [url_filter.rule("block", f"site{i}.org/a*b/") for i in range(40)]
    hits = url_filter.ShiftAnd(many).fitting(["x.site7.org", "site39.org"], ["/axxb/c", "/ab"])
    assert hits.shape == (2, 40) and hits[0].nonzero()[0].tolist() == [7] and not hits[1].any()
    assert url_filter.judge_urls(df.limit(0)).count() == 0


# -- 7 BPE, 8 packing ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_is_the_librarys(library):
    rng = random.Random(13)
    letters = list("abcdehilnorstuxyzABC'' .,!?019éèßÅ") + [
        "<|endoftext|>", "<|", "\u0301", "ΣΑΣ", "中", "😀", "\x1c", "\x85", "\xa0", "\u3000", "İ",
        "'s", "'re", "½", "²", "ª", "\n", "\x00", "ﬁ",
    ]
    rows = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(4000)]
    rows += texts(14, 300) + ["a" * 3000, "the" * 500, "!" * 70] + [t or "" for t in ODD]
    coder = bpe.SpeculativeBPE(bpe.vocabulary_path())
    expected = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    assert coder.encode_batch(rows) == expected
    for ids in expected[::50]:
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_digests_and_round_trip(documents, library):
    rows = texts(15, 20) + ODD
    got = bpe.round_trip_digests(documents(rows)).toPandas().set_index("doc_id")
    both = bpe.decode_documents(bpe.encode_documents(documents(rows)), name="back").collect()
    for row in both:
        text = rows[row["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["ids"] == ids and row["back"] == decoded
        digest = got.loc[row["doc_id"]]
        assert digest["n_tokens"] == len(ids)
        joined = " ".join(map(str, ids))
        assert digest["ids_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert digest["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.round_trip_digests(documents([])).count() == 0


def test_best_fit_decreasing_one_by_one():
    rng = random.Random(16)
    for _ in range(60):
        capacity = rng.choice([5, 20, 64, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 100))]
        bins: list[int] = []
        for size in sorted(sizes, reverse=True):
            fit = [(left, i) for i, left in enumerate(bins) if left >= size]
            if fit:
                bins[min(fit)[1]] -= size
            else:
                bins.append(capacity - size)
        placements, filled = packing.best_fit_decreasing(Counter(sizes), capacity), defaultdict(list)
        for size, number in Counter(sizes).items():
            own = sorted(p for p in placements if p[0] == size)
            for rank in range(number):
                _, start, first, per_bin, offset = [p for p in own if p[1] <= rank][-1]
                at, place = divmod(rank - start, per_bin)
                filled[first + at].append((offset + place * size, size))
        for parts in filled.values():
            ends = 0
            for offset, size in sorted(parts):
                assert offset == ends
                ends += size
        assert sorted(capacity - sum(s for _, s in p) for p in filled.values()) == sorted(bins)


def test_packed_pieces(documents, library):
    rows = texts(17, 60, 1, 900) + ODD + ["same again"] * 20
    got = packing.pack_documents(documents(rows), capacity=256, with_ids=True).toPandas()
    for i, own in got.groupby("doc_id"):
        ids = [*library.encode(rows[i] or "", add_special_tokens=False).ids, 0]
        own = own.sort_values("piece")
        assert [x for part in own["ids"] for x in part] == ids
        assert own["start"].tolist() == list(range(0, len(ids), 256))
        for row in own.itertuples():
            assert row.length == len(row.ids) <= 256
            assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
    assert got["doc_id"].nunique() == len(rows)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
        assert own["length"].sum() <= 256
    assert packing.pack_documents(documents([])).count() == 0


# -- 9 toxicity ---------------------------------------------------------------------------------------


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automaton_against_distances():
    terms = ["idiot", "clown", "worthless", "scum"]
    near = toxicity.LevenshteinTrie(toxicity.Trie({t: 1.0 for t in terms}), most_states=50)
    rng = random.Random(18)
    words = {"".join(rng.choices("idotclwnrhes", k=rng.randint(3, 10))) for _ in range(2000)}
    for term in terms:
        for i in range(len(term) + 1):
            words |= {term[:i] + "x" + term[i:], term[:i] + term[i + 1 :], term[:i] + "y" + term[i + 1 :]}
    for word in words:
        expected = any(len(t) >= toxicity.FUZZY_LENGTH and edits(word, t) <= 1 for t in terms)
        assert bool(near.near(word)) == expected, word


def test_toxicity_on_held_out_rows(spark, documents):
    rng = random.Random(19)
    clean = texts(20, 500, 20, 80)
    toxic = [
        " ".join(rng.choice(["idiot", "clown", "moron"]) if rng.random() < 0.1 else w for w in t.split())
        + " moron" for t in texts(21, 120, 20, 80)
    ]
    quoted = [t + ' he said "moron" and wrote' for t in texts(22, 3, 30, 40)]
    rows = clean + toxic + quoted + ODD + ["you mroron idiiot " * 2 + clean[0]]
    labels = [(i, int(i >= 500)) for i in range(620)] + [(None, 1), (3, None), (1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_documents(documents(rows), table).toPandas().set_index("doc_id").sort_index()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(rows))]
    assert got.sort_index()["held_out"].tolist() == held
    truth = np.array([500 <= i < 620 for i in range(620)])
    right = got.sort_index()["predicted"].to_numpy()[:620] == truth
    assert right[np.array(held[:620])].mean() > 0.97
    assert not got.loc[620:622, "predicted"].any()  # quotation
    assert got.loc[len(rows) - 1, "predicted"] == 1  # misspelled
    assert not got.loc[623 : len(rows) - 2, "predicted"].any()
    none = toxicity.score_documents(documents(rows), table.limit(0)).toPandas()
    assert not none["predicted"].any()
    model = toxicity.train(documents(rows), table)
    kept = toxicity.keep_clean(documents(rows), model)
    assert kept.columns == documents(rows).columns
    assert kept.count() == int((got["predicted"] == 0).sum())


# -- 10 surrogates -------------------------------------------------------------------------------------

PRIVATE = [
    r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"\+\d[\d ()-]{6,}\d", r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    r"\b\d{16}\b", r"\b[0-9a-f]{40}\b", r"\b\d{3}-\d{2}-\d{4}\b",
]


def luhn(number: str) -> bool:
    digits = [int(d) for d in reversed(number)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates_keep_format_identity_and_the_rest(documents):
    rows = [
        "Mail hsr.29@mail5.example.com twice: hsr.29@mail5.example.com, HSR.29@MAIL5.EXAMPLE.COM.",
        'call +1 (988) 555-2485 4984250489669609 or 127.0.0.1, token = "' + "0b" * 20 + '".',
        "Mr. John Smith and Mrs. Mary Smith met; Mr. Smith left. г-н Иванов 123-45-6789",
        "again +1 (988) 555-2485 and hsr.29@mail5.example.com",
        "version 4.0. of 12 March 2024, 1.5 or 3,000,000 are no private data",
        "card 1234567890123456",
    ] + ODD
    rows += [f"a{i}.{j}@b.co" for i in range(10) for j in range(10)]  # a format with little room
    got = surrogates.replace_entities(documents(rows), "key", count_column="n").toPandas()
    new = got.set_index("doc_id")["text"].where(got.set_index("doc_id")["text"].notna(), None)
    assert got["doc_id"].is_unique and len(got) == len(rows)
    for i, text in enumerate(rows):
        found = [v for p in PRIVATE for v in re.findall(p, text or "")]
        assert not any(v in new[i] for v in found)
        if i >= 6 and i < 6 + len(ODD) or i == 4:
            assert new[i] == text
        elif i < 4:
            shape = lambda t: [len(re.findall(p, t)) for p in PRIVATE]
            assert shape(new[i]) == shape(text)
    first = re.findall(PRIVATE[0], new[0])
    assert first[0] == first[1] == re.findall(PRIVATE[0], new[3])[0]
    assert first[2].rstrip(".") == first[0].upper()
    assert luhn(re.findall(PRIVATE[3], new[1])[0]) and new[5] != rows[5]
    assert re.findall(PRIVATE[1], new[1])[0].startswith("+1 (")
    names = re.match(r"Mr\. (\w+) (\w+) and Mrs\. (\w+) (\w+) met; Mr\. (\w+) left\. г-н (\w+)", new[2])
    assert names and names[2] == names[4] == names[5] != "Smith" and re.fullmatch("[А-я]+", names[6])
    many = [new[i] for i in range(6 + len(ODD), len(rows))]
    assert len(set(many)) == len(many) and not set(many) & set(rows)
    other = surrogates.replace_entities(documents(rows), "another key")
    assert other.columns == documents(rows).columns
    assert other.where("doc_id = 0").first()["text"] != new[0]
    assert surrogates.replace_entities(documents([]), "key").count() == 0


def test_surrogates_of_whole_names_and_of_names_without_titles(documents):
    rows = [
        "John came. Mr. John Smith spoke; Smith said so. John Smith's hat, Smithson, Johnny.",
        "Dr. Mary Jane Watson met Mr. McDonald, Mr. O'Brien and Prof. Dr. Lee Smith-Jones; O'Brien, Jane.",
        "Mr. J. R. Tolkien and Herr Ludwig van Beethoven: Tolkien, Beethoven. Mr. Washingtonian: Washingtonian",
        "Smith and John without a title",
    ]
    got = surrogates.replace_entities(documents(rows), "key", count_column="n").toPandas()
    got = got.set_index("doc_id").sort_index()
    new = got["text"]
    one = re.fullmatch(
        r"(\w+) came\. Mr\. (\w+) (\w+) spoke; (\w+) said so\. (\w+) (\w+)'s hat, Smithson, Johnny\.",
        new[0],
    )
    assert one and one[1] == one[2] == one[5] != "John" and one[3] == one[4] == one[6] != "Smith"
    real = "Mary Jane Watson Donald Brien Lee Smith Jones Tolkien Ludwig Beethoven Washington J. R.".split()
    assert not [name for name in real if name in new[1] + new[2]]
    two = re.fullmatch(
        r"Dr\. (\w+) (\w+) \w+ met Mr\. \w+, Mr\. (\w+) and Prof\. Dr\. \w+ \w+; (\w+), (\w+)\.", new[1]
    )
    assert two and two[3] == two[4] and two[2] == two[5]
    three = re.fullmatch(
        r"Mr\. \w\. \w\. (\w+) and Herr \w+ van (\w+): (\w+), (\w+)\. Mr\. (\w+): (\w+)", new[2]
    )
    assert three and three[1] == three[3] and three[2] == three[4] and three[5] == three[6]
    assert new[3] == rows[3]  # names are known within their text only
    assert got["n"].tolist() == [5, 6, 6, 0]
