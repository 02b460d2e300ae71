"""The whole run: sources in, catalog changed, report out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from callshelf.operators import report
from callshelf.operators.entries import annotate, catalog_entries, file_errors
from callshelf.operators.extract import extract_callables
from callshelf.operators.outcomes import POSITION, resolve_outcomes
from callshelf.operators.nouns import NounModel, non_nouns
from callshelf.operators.tags import without_words
from callshelf.operators.upsert import codes_changes, metadata_changes
from callshelf.session import release, scratch, stage_at
from callshelf.sources.store import CatalogStore


@dataclass(frozen=True)
class IngestRun:
    """What a run leaves behind. All frames are lazy and read staged tables."""

    stats: DataFrame
    status: DataFrame
    parse_errors: DataFrame
    upload_errors: DataFrame
    errors: DataFrame
    outcomes: DataFrame | None
    preview: DataFrame | None
    version: int | None
    staged: tuple[str, ...] = ()

    def release(self) -> None:
        """Give back the space of the staged tables. The frames cannot be read after."""
        for folder in self.staged:
            release(self.stats.sparkSession, folder)


def ingest(
    sources: DataFrame,
    store: CatalogStore,
    *,
    bypass: bool = False,
    dry_run: bool = False,
    base: str = "/",
    as_of: datetime | None = None,
    batch_id: str | None = None,
    extract: Callable[[DataFrame], DataFrame] = extract_callables,
    tag_options: dict[str, Any] | None = None,
    limits: dict[str, int] | None = None,
    words: DataFrame | NounModel | None = None,
) -> IngestRun:
    """Take ``sources(path, content[, read_error, arrival])`` into the catalog.

    Entries are decided in order of arrival (a text; rows without one come first), path,
    content hash and line, so several versions of a path count as if they had come in
    separate runs in that order, and every entry has one place. ``words(word)`` are left out
    of the tags; a ``NounModel`` (``callshelf.operators.nouns.learn``) leaves out the tags it
    calls no noun.

    Two tables are staged: the annotated callables (parsing and hashing run once) and the
    narrow outcomes. All that follows reads the few columns it needs of them.
    """
    runs = store.runs()
    store.require_tables(runs)
    as_of = as_of or datetime.now(timezone.utc)
    folders = [scratch(store.spark, "annotated"), scratch(store.spark, "outcomes")]
    annotated = annotate(extract(sources), **(limits or {}))
    # Written once, so a row keeps its number.
    seen = Observation("annotated")
    staged = stage_at(
        annotated.withColumn("row", F.monotonically_increasing_id())
        .observe(seen, *report.table_counters()),
        folders[0],
    )
    entries, failed = catalog_entries(staged), file_errors(staged)

    if dry_run:
        nothing = entries.withColumn("outcome", F.lit(None).cast("string")).limit(0)
        stats = report.observed_stats(store.spark, seen.get)
        return IngestRun(
            stats=stats,
            status=report.run_status(stats),
            parse_errors=failed,
            upload_errors=report.upload_errors(nothing),
            errors=report.error_report(failed, report.upload_errors(nothing)),
            outcomes=None,
            preview=report.preview(entries, store.metadata_keys(runs)),
            version=None,
            staged=(folders[0],),
        )

    narrow = entries.select(
        "cid", "code_cid", *POSITION, "name", "type", "file_path", "error"
    )
    decided = Observation("outcomes")
    outcomes = stage_at(
        resolve_outcomes(narrow, store.metadata_keys(runs), bypass=bypass, order=POSITION)
        .observe(decided, *report.outcome_counters()),
        folders[1],
    )
    tagged = metadata_changes(
        outcomes, base, POSITION, one_per_key=not bypass, **(tag_options or {})
    )
    if isinstance(words, NounModel):
        folders.append(scratch(store.spark, "tagged"))
        tagged = stage_at(tagged, folders[-1])
        words = non_nouns(words, tagged)
    if words is not None:
        tagged = without_words(tagged, words, key="cid")
    version = store.commit(
        codes_changes(outcomes, entries, as_of),
        tagged,
        batch_id=batch_id,
        runs=runs,
    )
    stats = report.observed_stats(store.spark, seen.get, decided.get)
    failures = report.upload_errors(outcomes)
    return IngestRun(
        stats=stats,
        status=report.run_status(stats),
        parse_errors=failed,
        upload_errors=failures,
        errors=report.error_report(failed, failures),
        outcomes=outcomes,
        preview=None,
        version=version,
        staged=tuple(folders),
    )
