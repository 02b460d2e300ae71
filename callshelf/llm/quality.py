"""Quality rules whose limits follow each language and source.

Two fixed rules come first (too few words, too many repeated passages). The documents that
pass them set the limits of the others: a KLL sketch per language and source describes each
measure, sketches of a language merge where a source has few documents, all merge where a
language has few, and a document is rejected where a measure lies ``fence`` times the
interquartile range beyond the quartiles. The limits are joined back to the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callshelf.llm.common import free_name, text_slices, texts_of, with_fields
from callshelf.session import stage

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Base rules: fewest words, and the largest share of words in repeated windows in percent.
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_different",
    "n_upper",
)
_COUNTS_TYPE = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"


@dataclass(frozen=True)
class Measure:
    """A number per document, the least spread its limit assumes, and the sides it bounds.

    The least spread keeps a source of nearly equal documents from rejecting the next one
    for a single character.
    """

    value: str
    least_spread: float
    upper: bool = True


MEASURES = {
    "symbol_rate": Measure("n_symbols / n_words", 0.02),
    "dup_line_rate": Measure("n_dup_lines / greatest(n_lines, 1)", 0.1),
    "upper_rate": Measure("n_upper / greatest(word_chars, 1)", 0.05),
    # log(different words) / log(words) hardly depends on the length of a clean text
    "variety": Measure("ln(n_different + 1) / ln(n_words + 1)", 0.02, upper=False),
}
FENCE = 5.0
LEAST_DOCUMENTS = 50
SKETCH_K = 200
_WHITE = " \t\n\x0b\x0c\r"


def repeat_words(words: list) -> int:
    """Words that lie in windows of ``WINDOW`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    covered, last = 0, 0  # words before `last` are counted
    for start, window in enumerate(windows):
        if found[window] > 1:
            covered += start + WINDOW - max(start, last)
            last = start + WINDOW
    return covered


def measure(text: str) -> tuple[int, ...]:
    """The values of ``COUNTS`` for a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space
    lines = text.split("\n") if "\n" in text else [text]
    seen: set[str] = set()
    n_lines = repeated = 0
    for line in lines:
        if line.strip(_WHITE):
            n_lines += 1
            repeated += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, _WHITE)),
        sum(map(text.count, SYMBOLS)),
        repeated,
        repeat_words(words),
        n_lines,
        len(set(words)),
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def with_counts(docs: DataFrame, name: str, text_column: str = "text") -> DataFrame:
    """``docs`` with a struct of the counts as a further column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_column):
            measured = list(zip(*map(measure, texts_of(batch, text_column))))
            counts = pa.StructArray.from_arrays(
                [pa.array(column, pa.int64()) for column in measured], list(COUNTS)
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, counts], [*batch.schema.names, name]
            )

    return docs.mapInArrow(run, with_fields(docs, (name, _COUNTS_TYPE)))


def base_failed(counts: str) -> Column:
    """Do the fixed rules reject a document with these counts (a struct column)?"""
    words = F.col(f"{counts}.n_words")
    return (words < LEAST_WORDS) | (
        100 * F.col(f"{counts}.n_repeat_words") > MOST_REPEAT_PERCENT * words
    )


def _values(counts: str) -> dict[str, Column]:
    field = {name: F.col(f"{counts}.{name}") for name in COUNTS}

    def value(expression: str) -> Column:
        for name in sorted(field, key=len, reverse=True):
            expression = expression.replace(name, f"`{counts}`.{name}")
        return F.expr(expression).cast("double")

    return {name: value(measure.value) for name, measure in MEASURES.items()}


def _limit(name: str, sketch: Column, fence: float) -> Column:
    low = F.kll_sketch_get_quantile_double(sketch, F.lit(0.25))
    high = F.kll_sketch_get_quantile_double(sketch, F.lit(0.75))
    reach = fence * F.greatest(high - low, F.lit(MEASURES[name].least_spread))
    return high + reach if MEASURES[name].upper else low - reach


def adaptive_limits(
    counted: DataFrame,
    counts: str,
    *,
    keys: tuple[str, str] = ("lang", "source"),
    fence: float = FENCE,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """``(_lang, _source, limits)``: one struct of limits for each language and source.

    A null language or source is a value like any other.
    """
    values = _values(counts)
    passed = counted.where(~base_failed(counts)).select(
        F.col(keys[0]).cast("string").alias("_lang"),
        F.col(keys[1]).cast("string").alias("_source"),
        *[value.alias(name) for name, value in values.items()],
    )
    by_source = stage(
        passed.groupBy("_lang", "_source").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.kll_sketch_agg_double(name, SKETCH_K).alias(name) for name in MEASURES],
        ),
        "quality-sketches",
    )
    merged = [
        F.sum("n").alias("n"),
        *[F.kll_merge_agg_double(name, SKETCH_K).alias(name) for name in MEASURES],
    ]
    # one row: the sketches of everything
    overall = by_source.agg(*merged).where("n > 0").select(
        *[_limit(name, F.col(name), fence).alias(name) for name in MEASURES]
    ).first()
    by_language = by_source.groupBy("_lang").agg(*merged)
    level = {"source": by_source.alias("source"), "language": by_language.alias("language")}

    def limit(name: str) -> Column:
        return (
            F.when(
                F.col("source.n") >= least_documents, _limit(name, F.col(f"source.{name}"), fence)
            )
            .when(
                F.col("language.n") >= least_documents,
                _limit(name, F.col(f"language.{name}"), fence),
            )
            .otherwise(F.lit(overall[name] if overall else None).cast("double"))
        )

    same = F.col("source._lang").eqNullSafe(F.col("language._lang"))
    return level["source"].join(level["language"], same).select(
        F.col("source._lang").alias("_lang"),
        F.col("source._source").alias("_source"),
        F.struct(*[limit(name).alias(name) for name in MEASURES]).alias("_limits"),
    )


def judged(
    counted: DataFrame,
    limits: DataFrame,
    counts: str,
    verdict: str,
    keys: tuple[str, str] = ("lang", "source"),
) -> DataFrame:
    """``counted`` with the boolean ``verdict``: kept or not."""
    within = F.lit(True)
    for name, value in _values(counts).items():
        limit = F.col(f"_limits.{name}")
        outside = value > limit if MEASURES[name].upper else value < limit
        within = within & ~F.coalesce(outside, F.lit(False))
    same = counted[keys[0]].cast("string").eqNullSafe(limits["_lang"]) & counted[
        keys[1]
    ].cast("string").eqNullSafe(limits["_source"])
    joined = counted.join(limits, same, "left")
    return joined.withColumn(verdict, ~base_failed(counts) & within).select(
        *[counted[c] for c in counted.columns], verdict
    )


def quality_report(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """Counts and verdict of each document: ``(id, COUNTS..., base_failed, kept)``.

    A null or empty text has no words and fails. Repeated rows are judged alike. Other
    columns play no part; a null language or source is a group of its own. An empty
    table gives an empty result.
    """
    narrow = docs.select(
        docs[id_column].alias(id_column), docs["lang"], docs["source"],
        docs[text_column].alias("text"),
    )
    counted = stage(with_counts(narrow, "_counts").drop("text"), "quality-counts")
    limits = adaptive_limits(counted, "_counts", **options)
    return judged(counted, limits, "_counts", "kept").select(
        id_column,
        *[F.col(f"_counts.{name}").alias(name) for name in COUNTS],
        base_failed("_counts").alias("base_failed"),
        "kept",
    )


def keep_quality(docs: DataFrame, *, text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Texts are counted twice, once for the limits and once beside the rows: that costs less
    than to write all texts or to shuffle them. Cases as in ``quality_report``.
    """
    narrow = docs.select(docs["lang"], docs["source"], docs[text_column].alias("text"))
    first = stage(with_counts(narrow, "_counts").drop("text"), "quality-counts")
    limits = adaptive_limits(first, "_counts", **options)
    counts, verdict = free_name(docs, "_counts"), free_name(docs, "_verdict")
    counted = with_counts(docs, counts, text_column)
    return judged(counted, limits, counts, verdict).where(F.col(verdict)).select(*docs.columns)
