"""Changed rows of both catalog tables from the entries a run uploads."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callshelf.functions.paths import is_test, path_tags
from callshelf.operators.outcomes import ORDER, POSITION, UPLOADED
from callshelf.schemas import CODES, METADATA


# Rows of an identifier and a number: some 10 MB.
BROADCAST_WINNERS = 100_000


def _uploaded(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == UPLOADED)


def code_winners(outcomes: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The position of the last uploaded entry of each immutable id.

    Narrow and combined map-side: a code that sits in a third of all files shrinks to
    one row per task before it is shuffled.
    """
    last = F.max(F.struct(*order)).alias("last")
    return (
        _uploaded(outcomes).groupBy("immutable_cid").agg(last).select("immutable_cid", "last.*")
    )


def codes_changes(
    outcomes: DataFrame,
    entries: DataFrame,
    as_of: datetime | Column,
    order: Sequence[str] = POSITION,
) -> DataFrame:
    """Rows to replace in ``codes``: the last entry wins, whole, both times restart.

    ``outcomes`` is narrow; the texts in ``entries`` (a table with the same ``row`` numbers)
    are looked up for winners only. Up to ``BROADCAST_WINNERS`` of them the texts stay where
    they are read: in the usual re-run nearly all entries are duplicates. More are met by
    a shuffle of the rows.
    """
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    texts = entries.select("row", "code_cid", "signature", "docstring", "source_code")
    winners = code_winners(outcomes, order).select("immutable_cid", "row")
    if outcomes.where(F.col("outcome") == UPLOADED).count() <= BROADCAST_WINNERS:
        winners = F.broadcast(winners)
    return texts.join(winners, "row").select(
        F.col("immutable_cid").alias("cid"),
        F.col("code_cid").alias("version_cid"),
        "signature",
        "docstring",
        F.col("source_code").alias("computer_code"),
        now.alias("created_at"),
        now.alias("updated_at"),
    ).select(*CODES.fieldNames())


def metadata_changes(
    outcomes: DataFrame,
    base: Column | str = "/",
    order: Sequence[str] = ORDER,
    *,
    one_per_key: bool = False,
    **tag_options,
) -> DataFrame:
    """Rows to insert or update in ``metadata``: the last entry of each interface id.

    ``code_cid`` is the immutable id, so an update leaves it as it was. With
    ``one_per_key`` (a run without bypass uploads one entry per interface) no shuffle.
    """
    entries = _uploaded(outcomes)
    if not one_per_key:
        fields = F.struct("immutable_cid", "name", "type", "file_path", "path")
        last = F.max_by(fields, F.struct(*order)).alias("last")
        entries = entries.groupBy("cid").agg(last).select("cid", "last.*")
    return entries.select(
        "cid",
        F.col("immutable_cid").alias("code_cid"),
        F.col("name").alias("code_name"),
        F.col("type").alias("code_type"),
        is_test(F.col("name"), F.col("path")).alias("is_test"),
        "file_path",
        path_tags(F.col("path"), base, **tag_options).alias("tags"),
    ).select(*METADATA.fieldNames())
