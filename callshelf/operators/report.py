"""Run statistics, error report, dry run and status as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callshelf.functions.identity import short_id
from callshelf.functions.verdict import NO_DOCSTRING, NOT_STANDALONE
from callshelf.operators.outcomes import DUPLICATE, ERROR, ORDER, UPLOADED, mark_known


def _in_table() -> dict:
    is_callable = F.col("name").isNotNull()
    return {
        "files_scanned": ~is_callable,
        "callables_found": is_callable,
        "skipped_not_standalone": F.col("reject_reason") == NOT_STANDALONE,
        "skipped_no_docstring": F.col("reject_reason") == NO_DOCSTRING,
        "parse_errors": F.col("parse_error").isNotNull(),
    }


def _in_outcomes() -> dict:
    return {
        "skipped_duplicates": F.col("outcome") == DUPLICATE,
        "new_uploads": F.col("outcome") == UPLOADED,
        "upload_errors": F.col("outcome") == ERROR,
    }


def table_counters() -> list:
    """Counters of the annotated table, for ``DataFrame.observe`` on the job that writes it."""
    return [F.count_if(test).alias(n) for n, test in _in_table().items()]


def outcome_counters() -> list:
    """Counters of the outcomes, for ``DataFrame.observe`` on the job that writes them."""
    return [F.count_if(test).alias(n) for n, test in _in_outcomes().items()]


def observed_stats(spark, table: dict, outcomes: dict | None = None) -> DataFrame:
    """The row of ``run_stats`` from counters observed while the tables were written."""
    got = {**{n: 0 for n in _in_outcomes()}, **table, **(outcomes or {})}
    valid = got["callables_found"] - got["skipped_not_standalone"] - got["skipped_no_docstring"]
    row = (
        got["files_scanned"], got["callables_found"], got["skipped_not_standalone"],
        got["skipped_no_docstring"], got["skipped_duplicates"], got["new_uploads"], valid,
        got["parse_errors"], got["upload_errors"], got["parse_errors"] + got["upload_errors"],
    )
    return spark.createDataFrame([row], ", ".join(f"{n} bigint" for n in STATS_COLUMNS))


STATS_COLUMNS = (
    "files_scanned", "callables_found", "skipped_not_standalone", "skipped_no_docstring",
    "skipped_duplicates", "new_uploads", "valid_callables", "parse_errors", "upload_errors",
    "errors",
)


def run_stats(annotated: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """One row of counters. Without ``outcomes`` (dry run) nothing is uploaded or skipped
    as a duplicate. Each table is counted in one pass over narrow columns; ``ingest``
    observes the same counters while it writes instead (``observed_stats``)."""
    in_table, in_outcomes = _in_table(), _in_outcomes()
    counted = annotated.agg(*[F.count_if(test).alias(n) for n, test in in_table.items()])
    if outcomes is None:
        counted = counted.withColumns({n: F.lit(0) for n in in_outcomes})
    else:
        own = outcomes.agg(*[F.count_if(test).alias(n) for n, test in in_outcomes.items()])
        counted = counted.unionByName(own, allowMissingColumns=True)
    # one or two rows from here on
    counters = [*in_table, *in_outcomes]
    total = counted.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counters])
    return total.select(
        *[name for name in counters if not name.endswith("_errors")],
        (
            F.col("callables_found")
            - F.col("skipped_not_standalone")
            - F.col("skipped_no_docstring")
        ).alias("valid_callables"),
        "parse_errors",
        "upload_errors",
        (F.col("parse_errors") + F.col("upload_errors")).alias("errors"),
    )


def run_status(stats: DataFrame) -> DataFrame:
    """0 without errors, 1 with errors beside uploads, 2 with errors only."""
    status = (
        F.when(F.col("errors") == 0, 0).when(F.col("new_uploads") > 0, 1).otherwise(2)
    )
    return stats.select(status.alias("status"))


def upload_errors(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == ERROR).select(*ORDER, "name", "error")


def error_report(
    parse_errors: DataFrame,
    upload_errors: DataFrame,
    k: int = 5,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """The first ``k`` errors of each kind in run order, and how many more there are.

    Top-k is taken per task before rows meet; totals are a separate small aggregate.
    """
    columns = ["kind", *order, "name", "error"]
    kinds = {
        "parse": parse_errors.withColumns(
            {"line_number": F.lit(None).cast("int"), "name": F.lit(None).cast("string")}
        ),
        "upload": upload_errors,
    }
    shown, totals = None, None
    for kind, errors in kinds.items():
        errors = errors.withColumn("kind", F.lit(kind)).select(*columns)
        top = errors.orderBy(*order).limit(k)
        count = errors.agg(F.count(F.lit(1)).alias("total")).withColumn("kind", F.lit(kind))
        shown = top if shown is None else shown.unionByName(top)
        totals = count if totals is None else totals.unionByName(count)
    # at most 2 * k rows from here on
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
    return shown.join(totals, "kind").select(
        "kind",
        rank.alias("rank"),
        F.col("path").alias("file"),
        F.col("name").alias("callable"),
        "error",
        F.greatest(F.col("total") - k, F.lit(0)).alias("more"),
    )


def preview(entries: DataFrame, metadata: DataFrame, key: str = "cid") -> DataFrame:
    """What a run would do, entry by entry, without deciding between entries of the run.

    ``known`` says whether the catalog has the entry's key.
    """
    wanted = entries.select(*ORDER, "name", key, short_id(F.col("code_cid")).alias("short_cid"))
    return mark_known(wanted, metadata, key, spread=ORDER).drop(key)


# The labels of the summary and their order.
SUMMARY = (
    ("Files scanned", "files_scanned"),
    ("Callables found", "callables_found"),
    ("Skipped (not standalone)", "skipped_not_standalone"),
    ("Skipped (no docstring)", "skipped_no_docstring"),
    ("Valid callables", "valid_callables"),
    ("New uploads", "new_uploads"),
    ("Duplicates skipped", "skipped_duplicates"),
    ("Errors", "errors"),
)
RULE = "=" * 50


def readable_total(store) -> int | None:
    """The number of code rows, or None if the catalog cannot be read: the report goes on
    without it. One number comes to the driver."""
    try:
        row = store.total().first()
    except Exception:  # any failure to read the catalog: the total is left out
        return None
    return None if row is None else row["total"]


def summary_lines(stats: DataFrame, total: int | None) -> DataFrame:
    """``(n, line)``: the report of a run as text lines, counters always, the catalog's total
    only if it was read (``readable_total``)."""
    lines = [F.lit(RULE), F.lit("Upload Complete!"), F.lit(RULE)]
    lines += [
        F.concat(F.rpad(F.lit(f"{label}:"), 26, " "), F.col(column).cast("string"))
        for label, column in SUMMARY
    ]
    if total is not None:
        lines += [F.lit(""), F.concat(F.lit("Database now contains "),
                                      F.format_number(F.lit(total), 0), F.lit(" code entries"))]
    numbered = F.array(*[F.struct(F.lit(i + 1).alias("n"), line.alias("line"))
                         for i, line in enumerate(lines)])
    return stats.select(F.inline(numbered))
