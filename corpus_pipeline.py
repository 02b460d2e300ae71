"""From raw documents to packed training sequences, one operator for each stage.

Each stage gets what the one before it kept, written as Parquet and read again. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callshelf.llm.near_dedup import keep_one_of_each
from callshelf.llm.packing import pack_documents
from callshelf.llm.quality import keep_quality
from callshelf.llm.queries import SURROGATE_KEY
from callshelf.llm.surrogates import replace_entities
from callshelf.llm.toxicity import keep_clean, train
from callshelf.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_quality(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; ``n_chars``, if there, follows the new text."""
    replaced = replace_entities(docs, SURROGATE_KEY)
    if "n_chars" in replaced.columns:
        kind = docs.schema["n_chars"].dataType
        replaced = replaced.withColumn("n_chars", F.char_length("text").cast(kind))
    return replaced


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of bounded length: where each piece of a document lies."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
