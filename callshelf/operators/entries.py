"""From callables to catalog entries: verdicts, identifiers, tags, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callshelf.functions import identity
from callshelf.functions.fixed_values import CALLABLE_TYPES, CID_MAX_CHARS
from callshelf.functions.paths import is_test, path_tags, stored_path
from callshelf.functions.verdict import reject_reason


def with_reject_reason(callables: DataFrame) -> DataFrame:
    reason = reject_reason(
        F.col("type"),
        F.col("name"),
        F.col("signature"),
        F.col("docstring"),
        F.col("source_code"),
        F.col("decorators"),
    )
    return callables.withColumn("reject_reason", reason)


def valid_callables(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reject_reason").isNull())


def with_code_cid(df: DataFrame) -> DataFrame:
    text = identity.code_text(F.col("signature"), F.col("docstring"), F.col("source_code"))
    return df.withColumn("code_cid", identity.cid(text))


def with_interface_cid(df: DataFrame) -> DataFrame:
    """Adds ``cid``; needs ``file_path`` as stored."""
    text = identity.interface_text(
        F.col("signature"), F.col("docstring"), F.col("type"), F.col("file_path")
    )
    return df.withColumn("cid", identity.cid(text))


def with_path_facts(df: DataFrame, base: Column | str = "/", **tag_options) -> DataFrame:
    """Adds ``is_test`` and ``tags``."""
    return df.withColumns(
        {
            "is_test": is_test(F.col("name"), F.col("path")),
            "tags": path_tags(F.col("path"), base, **tag_options),
        }
    )


def constraint_error(
    *, text_max_bytes: int | None = None, cid_max_chars: int = CID_MAX_CHARS
) -> Column:
    """Why an entry does not fit the tables, or null. Null texts are no size error.

    Texts may have any size unless ``text_max_bytes`` says otherwise.
    """

    def too_long(size: Column, limit: int | None, column: str) -> Column:
        if limit is None:
            return F.lit(None).cast("string")
        return F.when(size > limit, f"Data too long for column '{column}'")

    return F.coalesce(
        F.when(F.col("source_code").isNull(), "Column 'computer_code' cannot be null"),
        too_long(F.length("cid"), cid_max_chars, "cid"),
        too_long(F.length("code_cid"), cid_max_chars, "version_cid"),
        too_long(F.octet_length("signature"), text_max_bytes, "signature"),
        too_long(F.octet_length("docstring"), text_max_bytes, "docstring"),
        too_long(F.octet_length("source_code"), text_max_bytes, "computer_code"),
        F.when(~F.col("type").isin(CALLABLE_TYPES), "Data truncated for column 'code_type'"),
    )


def check_constraints(entries: DataFrame, **limits: int | None) -> DataFrame:
    return entries.withColumn("error", constraint_error(**limits))


def annotate(extracted: DataFrame, **limits: int) -> DataFrame:
    """Everything a run needs to know of each extracted row, in one narrow pass.

    Positions (``arrival``, ``twin``) are kept; an extractor without them gives one arrival.
    Keeps file rows (``parse_error``) and rejected callables (``reject_reason``) for
    counting, without their texts. Valid callables get ``file_path``, ``code_cid``,
    ``cid`` and, if they do not fit the tables, ``error``.
    """
    for name, kind in (("arrival", "string"), ("twin", "bigint")):
        if name not in extracted.columns:
            extracted = extracted.withColumn(name, F.lit(None).cast(kind))
    named = with_reject_reason(extracted.withColumnRenamed("error", "parse_error"))
    is_callable = F.col("name").isNotNull()
    judged = named.withColumn("reject_reason", F.when(is_callable, F.col("reject_reason")))
    valid = is_callable & F.col("reject_reason").isNull()
    kept = judged.select(
        "path",
        "line_number",
        "name",
        "type",
        F.when(valid, F.col("signature")).alias("signature"),
        F.when(valid, F.coalesce("docstring", F.lit(""))).alias("docstring"),
        F.when(valid, F.col("source_code")).alias("source_code"),
        stored_path(F.col("path")).alias("file_path"),
        "reject_reason",
        "parse_error",
        "arrival",
        "twin",
    )
    # without texts both identifiers are null
    identified = with_interface_cid(with_code_cid(kept))
    return identified.withColumn("error", F.when(valid, constraint_error(**limits)))


def found_callables(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.col("name").isNotNull())


def file_errors(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.col("parse_error").isNotNull()).select(
        "path", F.col("parse_error").alias("error")
    )


def catalog_entries(annotated: DataFrame) -> DataFrame:
    """The valid callables, ready for outcomes and upserts."""
    return valid_callables(found_callables(annotated)).drop("reject_reason", "parse_error")
