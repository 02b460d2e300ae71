"""A learned noun guesser for path tags, trained by Spark on a corpus of prose.

The reference keeps the nouns of a path with a part-of-speech model. Here the model is
learned from how words stand in the corpus:

* **Evidence.** Texts are cut into words, numbers and sentence marks. A word stands in a
  noun's place after an article of its document's language, after a number, or with a
  capital letter inside a sentence. For each word (lower-cased) Spark counts its uses ``n``
  and those in a noun's place ``c``.
* **Endings.** Words pass their counts to their last 1..``ENDING`` letters, a trie of endings
  kept as a table of (ending, n, c).
* **Back-off.** The estimate of a word starts at the corpus rate ``c/n`` and is refined by
  each longer ending and at last by the word itself:
  ``p = (c + STRENGTH * p_shorter) / (n + STRENGTH)``. Unseen words take their longest
  endings' estimate; a word is a noun if its estimate reaches ``RATIO`` times the corpus
  rate.

All steps are grouped counts and joins: the corpus is read once, no row goes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callshelf.session import stage

# Articles by language (words before a noun).
ARTICLES = {
    "en": ["the", "a", "an"],
    "fr": ["le", "la", "les", "l", "un", "une", "des", "du"],
    "de": ["der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer"],
    "es": ["el", "la", "los", "las", "un", "una", "unos", "unas"],
}
#: Words, numbers and the marks that end a sentence.
TOKEN = r"\p{L}+|[0-9]+|[.!?]"
#: Longest ending that is counted.
ENDING = 4
#: Weight of the shorter ending's estimate against a longer ending's counts.
STRENGTH = 5.0
#: A noun stands in a noun's place at least this many times as often as the average word.
RATIO = 1.5
#: Digits of the estimates that are kept (all steps are exact before rounding).
DIGITS = 9


@dataclass
class NounModel:
    """Counts learned from a corpus: ``words(word, n, c)``, ``endings(ending, n, c)`` and
    the corpus totals ``totals(n, c)`` (one row)."""

    words: DataFrame
    endings: DataFrame
    totals: DataFrame


def _article(prev: Column, lang: Column) -> Column:
    cases = None
    for code, words in ARTICLES.items():
        test = F.lower(prev).isin(words)
        cases = F.when(lang == code, test) if cases is None else cases.when(lang == code, test)
    return F.coalesce(cases.otherwise(F.lit(False)), F.lit(False))


def word_places(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(word, noun_place): every word of every text, lower-cased, and whether it stands in a
    noun's place. Null texts have no words; a null language has no articles."""
    tokens = F.concat(
        F.array(F.lit(".")),
        F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)),
    )
    # a column of its own: the texts are cut once, not for each use of the tokens
    cut = docs.select(F.col(lang).cast("string").alias("_lang"), tokens.alias("_tokens"))
    steps = F.size("_tokens") - 1
    pairs = F.arrays_zip(F.slice("_tokens", 1, steps).alias("prev"),
                         F.slice("_tokens", 2, steps).alias("word"))
    placed = cut.select("_lang", F.explode(pairs).alias("p")).select("_lang", "p.prev", "p.word")
    word, prev = F.col("word"), F.col("prev")
    first = F.substring(word, 1, 1)
    capital = ~prev.isin(".", "!", "?") & (first != F.lower(first))
    # a token is a word, a number or one mark, so its place in byte order tells which
    number = (prev >= "0") & (prev < ":")
    noun_place = _article(prev, F.col("_lang")) | number | capital
    return placed.where(word >= "A").select(
        F.lower(word).alias("word"), noun_place.cast("long").alias("noun_place")
    )


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> NounModel:
    """Count words and endings of ``docs``; see the module's text."""
    words = word_places(docs, text, lang).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("noun_place").alias("c")
    )
    # before its endings are counted, or the corpus would be read a second time for them
    words = stage(words, "noun-words")
    endings = (
        words.select("n", "c", F.explode(F.sequence(F.lit(1), F.least(F.char_length("word"),
                                                                        F.lit(ENDING)))).alias("k"),
                     "word")
        .select(F.expr("substring(word, -k)").alias("ending"), "n", "c")
        .groupBy("ending").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    )
    endings = stage(endings, "noun-endings")
    totals = words.agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return NounModel(words, endings, totals)


def estimates(model: NounModel, words: DataFrame, word: str = "word") -> DataFrame:
    """``words`` (distinct values of ``word``) with ``p``, the backed-off estimate, and
    ``noun`` (``p`` at least ``RATIO`` times the corpus rate). Null words are no nouns; a model without
    counts calls nothing a noun."""
    asked = words.select(F.col(word).alias("_w")).where(F.col("_w").isNotNull()).distinct()
    lowered = F.lower(F.col("_w"))
    chain = (
        asked.where(F.char_length("_w") > 0)
        .select("_w", F.explode(F.sequence(F.lit(1), F.least(F.char_length("_w"),
                                                             F.lit(ENDING)))).alias("k"))
        .withColumn("ending", F.expr("substring(lower(_w), -k)"))
        .join(model.endings, "ending", "left")
        .groupBy("_w")
        .agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"),
                                                   F.coalesce("c", F.lit(0)).alias("c"))))
             .alias("chain"))
    )
    # two numbers: the corpus rate is a constant of the plan
    total = model.totals.first()
    rate = F.lit(total["c"] / total["n"] if total and total["n"] else None).cast("double")

    def back_off(p: Column, step: Column) -> Column:
        return (step["c"] + F.lit(STRENGTH) * p) / (step["n"] + F.lit(STRENGTH))

    counts = model.words.select(F.col("word").alias("_lw"), F.col("n").alias("_nw"),
                                F.col("c").alias("_cw"))
    scored = (
        asked.join(chain, "_w", "left")
        .join(counts, lowered == F.col("_lw"), "left")
        .withColumn("_ends", F.aggregate(F.coalesce("chain", F.array().cast(
            "array<struct<k:int,n:bigint,c:bigint>>")), rate, back_off))
        .withColumn("_p", (F.coalesce("_cw", F.lit(0)) + F.lit(STRENGTH) * F.col("_ends"))
                    / (F.coalesce("_nw", F.lit(0)) + F.lit(STRENGTH)))
    )
    p = F.round(F.col("_p"), DIGITS)
    return scored.select(
        F.col("_w").alias(word), p.alias("p"),
        F.coalesce(F.col("_p") >= rate * F.lit(RATIO), F.lit(False)).alias("noun"),
    )


def non_nouns(model: NounModel, tagged: DataFrame, tags: str = "tags") -> DataFrame:
    """``word``: the tags of ``tagged`` that the model calls no noun, for
    ``callshelf.operators.tags.without_words`` and ``ingest(words=...)``."""
    words = tagged.select(F.explode(tags).alias("word")).distinct()
    return estimates(model, words).where(~F.col("noun")).select("word")
