"""Tag operators that need a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# A word such as a project's name may sit in every path. Its rows are spread over this
# many parts, and the list, which is a dictionary, is repeated for each.
SALTS = 32


def without_words(tagged: DataFrame, words: DataFrame, key: str = "path") -> DataFrame:
    """Take the words of ``words(word)`` out of ``tags``, for one row per ``key``.

    Stands in for a part-of-speech model: the caller brings the list of non-nouns. Spark
    chooses the join by the size of the list.
    """
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    listed = words.select(F.lower("word").alias("word"), F.explode(salts).alias("salt"))
    kept = (
        tagged.select(key, salt, F.explode("tags").alias("word"))
        .join(listed, ["word", "salt"], "left_anti")
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("word")).alias("_kept"))
    )
    none = F.array().cast("array<string>")
    return (
        tagged.join(kept, key, "left").withColumn("tags", F.coalesce("_kept", none)).drop("_kept")
    )


def tag_counts(tagged: DataFrame) -> DataFrame:
    return (
        tagged.select(F.explode("tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )
