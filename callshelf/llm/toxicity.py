"""Toxicity by a lexicon, spelled right or nearly so, and by the context it stands in.

The lexicon is learned from labelled documents: words, and beginnings of words, that toxic
documents have far more often than others. It is kept as a trie. Words within one edit of an
entry are found by the intersection of the trie with the Levenshtein automaton of the word:
its states are sets of (trie node, edits so far), made when first needed and kept, so most
words are done after the few letters that lead out of the lexicon. A window around each
term tells quotation (quotation marks, words of reporting) from abuse (words of address). A
logistic regression turns the sums into a score.

The classifier is fitted on a bounded sample of labelled rows (``LABELLED_ROWS``), chosen by a
hash of their ids. Only texts are inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callshelf.llm.common import crc32_of, free_name, text_slices, texts_of, with_fields
from callshelf.session import stage

#: Bound of the sample that lexicon and weights are learned from.
LABELLED_ROWS = 10_000
#: Every fifth id is held out: it is never learned from.
FOLDS = 5
LEXICON_TERMS = 500
LEAST_TOXIC_SHARE = 0.01
LEAST_TOXIC_DOCUMENTS = 3
LEAST_LOG_ODDS = 1.6
#: Entries of this length or more also match with one edit, at part of their weight.
FUZZY_LENGTH = 5
FUZZY_WEIGHT = 0.7
STEMS = range(4, 9)
WINDOW = 6
CACHED_WORDS = 600_000

_find_words = re.compile(r"[^\W_]+")
# Words of reporting and of address in the languages at hand.
REPORTING = frozenset(
    "said says wrote writes called quoted quote sagte schrieb nannte zitiert dit écrit appelle"
    " cite dijo escribió llamó cita".split()
)
ADDRESS = frozenset("you your yours du dich dein ihr euch tu te toi vous votre usted tú ti".split())
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}

FEATURES = ("abuse", "quoted", "density", "strongest", "terms")


def words_with_places(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _find_words.finditer(text)]


class Trie:
    """Terms and their weights; ``stem`` terms also match every longer word."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.depth: list[int] = [0]
        for term, weight in weights.items():
            node = 0
            for letter in term.rstrip("*"):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.whole.append(0.0)
                    self.stem.append(0.0)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][letter]
            place = self.stem if term.endswith("*") else self.whole
            place[node] = max(place[node], weight)

    def exact(self, word: str) -> float:
        """The best weight of the word itself and of stems it begins with."""
        node, best = 0, 0.0
        for letter in word:
            node = self.children[node].get(letter, -1)
            if node < 0:
                return best
            best = max(best, self.stem[node])
        return max(best, self.whole[node])


class LevenshteinTrie:
    """All words within one edit of a whole term of the trie, as a lazily made automaton."""

    def __init__(self, trie: Trie, edits: int = 1, most_states: int = 200_000) -> None:
        self.trie, self.edits, self.most_states = trie, edits, most_states
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.weights: list[float] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, state: set) -> frozenset:
        """With letters of terms left out."""
        best: dict[int, int] = {}
        todo = list(state)
        while todo:
            node, spent = todo.pop()
            if best.get(node, self.edits + 1) <= spent:
                continue
            best[node] = spent
            if spent < self.edits:
                todo.extend((child, spent + 1) for child in self.trie.children[node].values())
        return frozenset(best.items())

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.weights.append(
                max(
                    (self.trie.whole[n] for n, _ in state if self.trie.depth[n] >= FUZZY_LENGTH),
                    default=0.0,
                )
            )
            self.steps.append({})
        return self.numbers[state]

    def _step(self, number: int, letter: str) -> int:
        after: set = set()
        for node, spent in self.states[number]:
            children = self.trie.children[node]
            if letter in children:
                after.add((children[letter], spent))
            if spent < self.edits:
                after.add((node, spent + 1))
                after.update((child, spent + 1) for child in children.values())
        self.steps[number][letter] = result = self._number(self._closed(after))
        return result

    def near(self, word: str) -> float:
        """The best weight of a term within one edit, or 0."""
        if len(self.states) > self.most_states:
            self._reset()
        state = self.start
        for letter in word:
            known = self.steps[state].get(letter)
            state = self._step(state, letter) if known is None else known
            if not self.states[state]:
                return 0.0
        return self.weights[state]


@dataclass
class Model:
    """Terms with their weights, words near a term that clean documents use, and the rest."""

    lexicon: dict[str, float] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [-3.0, *[0.0] * len(FEATURES)])
    means: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    scales: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Places between quotation marks that open and close in one paragraph."""
    spans, start, closing = [], -1, ""
    for i, letter in enumerate(text):
        if start >= 0:
            if letter == closing:
                spans.append((start, i))
                start = -1
            elif letter == "\n":
                start = -1
        elif letter in _QUOTES:
            start, closing = i, _QUOTES[letter]
    return spans


class Featurizer:
    """The features of texts, with caches for words already looked at."""

    def __init__(self, lexicon: dict[str, float], ordinary: frozenset[str] = frozenset()) -> None:
        self.trie = Trie(lexicon)
        self.near = LevenshteinTrie(self.trie)
        self.ordinary = ordinary
        self.seen: set[str] = set()
        self.hits: dict[str, float] = {}

    def _look_at(self, words: set[str]) -> None:
        if len(self.seen) > CACHED_WORDS:
            self.seen, self.hits = set(), {}
        for word in words:
            weight = self.trie.exact(word)
            if not weight and len(word) >= FUZZY_LENGTH - 1 and word not in self.ordinary:
                weight = FUZZY_WEIGHT * self.near.near(word)
            if weight:
                self.hits[word] = weight
        self.seen |= words

    def features(self, texts: list[str]) -> list[tuple[float, ...]]:
        lowered = [text.lower() for text in texts]
        split = [_find_words.findall(text) for text in lowered]
        different = [set(words) for words in split]
        self._look_at(set().union(*different) - self.seen)
        none = (0.0,) * len(FEATURES)
        result = []
        for text, words, own in zip(lowered, split, different):
            result.append(none if self.hits.keys().isdisjoint(own) else self._one(text, words))
        return result

    def _one(self, text: str, words: list[str]) -> tuple[float, ...]:
        places = words_with_places(text)
        spans = quoted_spans(text)
        abuse = quoted = strongest = 0.0
        terms: set[str] = set()
        for i, (word, begin, end) in enumerate(places):
            weight = self.hits.get(word)
            if weight is None:
                continue
            around = [w for w, _, _ in places[max(0, i - WINDOW) : i + WINDOW + 1]]
            inside = any(a < begin and end <= b for a, b in spans)
            if inside and not ADDRESS.isdisjoint(around):
                quoted += weight / 2
                abuse += weight / 2
            elif inside or not REPORTING.isdisjoint(around):
                quoted += weight
            else:
                abuse += weight * (1.5 if not ADDRESS.isdisjoint(around) else 1.0)
                strongest = max(strongest, weight)
            terms.add(word)
        return (
            math.log1p(abuse),
            math.log1p(quoted),
            math.log1p(100 * abuse / len(words)),
            strongest,
            math.log1p(len(terms)),
        )


def scores(model: Model, features: np.ndarray) -> np.ndarray:
    x = (features - model.means) / model.scales
    z = model.weights[0] + x @ np.array(model.weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(features: np.ndarray, labels: np.ndarray, model: Model, ridge: float = 1.0) -> Model:
    """Logistic regression with a ridge, by Newton steps."""
    model.means = features.mean(axis=0).tolist()
    model.scales = (features.std(axis=0) + 1e-6).tolist()
    x = np.column_stack([np.ones(len(features)), (features - model.means) / model.scales])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + penalty @ w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w.tolist()
    return model


def held_out(id_column) -> F.Column:
    return F.pmod(crc32_of(id_column), F.lit(FOLDS)) == 0


def _terms_of(text: str) -> set[str]:
    words = set(_find_words.findall(text.lower()))
    return words | {word[:n] + "*" for word in words for n in STEMS if len(word) > n}


def train(docs: DataFrame, labels: DataFrame, *, labelled_rows: int = LABELLED_ROWS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Held-out ids, null ids and null labels take no part; of several labels of an id the
    greatest counts. Of texts with the same middle passage one is learned from, so that
    copies do not turn their words into terms. Without labelled rows of both kinds the model
    calls nothing toxic.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    # By least hash, so at most `labelled_rows` ids are broadcast.
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    words = F.split(F.trim(F.lower("text")), r"\s+")
    middle = F.slice(words, (F.size(words) / 2).cast("int") + 1, 8)
    learned = stage(
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .withColumn("_key", F.xxhash64(F.coalesce(middle, F.array())))
        .dropDuplicates(["_key"])
        .drop("_key"),
        "labelled",
    )
    totals = {row["toxic"]: row["count"] for row in learned.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), sum(n for kind, n in totals.items() if kind != 1)
    if not toxic or not clean:
        return Model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found: Counter = Counter()
            bad: Counter = Counter()
            for text, kind in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                terms = _terms_of(text)
                found.update(terms)
                if kind == 1:
                    bad.update(terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found, pa.string()),
                    pa.array(found.values(), pa.int64()),
                    pa.array([bad[term] for term in found], pa.int64()),
                ],
                ["term", "n", "bad"],
            )

    odds = F.log(
        ((F.col("bad") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("bad") + 0.5) / (clean + 1))
    )
    least = max(LEAST_TOXIC_DOCUMENTS, LEAST_TOXIC_SHARE * toxic)
    terms = stage(
        learned.select("text", "toxic")
        .mapInArrow(count, "term string, n bigint, bad bigint")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")),
        "terms",
    )
    lexicon = (
        terms.where(F.col("bad") >= least)
        .withColumn("odds", odds)
        .where(F.col("odds") >= LEAST_LOG_ODDS)
        .orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term")
        .limit(LEXICON_TERMS)
        .collect()
    )
    model = Model(_specific({row["term"]: (row["odds"], row["bad"]) for row in lexicon}))
    model.ordinary = _ordinary(terms, model)
    found = with_features(learned.select("text", "toxic"), model, "f").select("toxic", "f").collect()
    features = np.array([list(row["f"]) for row in found], dtype=float)
    return fitted(features, np.array([row["toxic"] == 1 for row in found], dtype=float), model)


def _specific(terms: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Without stems that hardly stand for more than one longer term does."""
    kept = {}
    for term, (odds, bad) in terms.items():
        stem = term.rstrip("*")
        longer = (
            other_bad
            for other, (_, other_bad) in terms.items()
            if other != term and other.startswith(stem) and len(other.rstrip("*")) >= len(stem)
        )
        if not term.endswith("*") or max(longer, default=0) < 0.8 * bad:
            kept[term] = round(odds, 4)
    return kept


def _ordinary(terms: DataFrame, model: Model) -> frozenset[str]:
    """Words within one edit of a term that clean documents use: no misspellings.

    As few as the words near at most ``LEXICON_TERMS`` terms are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model.lexicon)
        near = LevenshteinTrie(trie)
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if near.near(w) and not trie.exact(w)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["term"])

    words = terms.where(~F.endswith("term", F.lit("*")) & (F.col("n") > F.col("bad")))
    return frozenset(row[0] for row in words.select("term").mapInArrow(run, "term string").collect())


_featurizers: dict[int, Featurizer] = {}


def with_features(docs: DataFrame, model: Model, name: str, text_column: str = "text") -> DataFrame:
    """``docs`` with the features of each text as ``array<double>`` in column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((frozenset(model.lexicon.items()), model.ordinary))
        if key not in _featurizers:  # one model at a time in a Python worker
            _featurizers.clear()
            _featurizers[key] = Featurizer(model.lexicon, model.ordinary)
        for batch in text_slices(batches, text_column):
            found = _featurizers[key].features(texts_of(batch, text_column))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.float64()))],
                [*batch.schema.names, name],
            )

    return docs.mapInArrow(run, with_fields(docs, (name, "array<double>")))


def _score(model: Model, name: str) -> F.Column:
    z = F.lit(model.weights[0])
    for i, (weight, mean, scale) in enumerate(zip(model.weights[1:], model.means, model.scales)):
        z = z + F.lit(weight) * (F.col(name)[i] - F.lit(mean)) / F.lit(scale)
    return 1 / (1 + F.exp(-z))


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs``.

    A null or empty text has no terms and gets the score of clean texts. Repeated rows are
    scored alike; other columns play no part; an empty table gives an empty result.
    """
    model = train(docs, labels, **options)
    narrow = docs.select("doc_id", "text")
    return with_features(narrow, model, "_features").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        _score(model, "_features").alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with their own columns."""
    name = free_name(docs, "_features")
    scored = with_features(docs, model, name, text_column)
    return scored.where(_score(model, name) < 0.5).select(*docs.columns)
