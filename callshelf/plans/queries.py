"""Registered queries. Each takes ``(spark, sf_dir)`` and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callshelf.functions import identity
from callshelf.functions.paths import path_tags, tags_json, tags_json_text
from callshelf.operators import outcomes as oc
from callshelf.operators import report
from callshelf.operators.entries import (
    annotate,
    catalog_entries,
    check_constraints,
    valid_callables,
    with_code_cid,
    with_path_facts,
    with_reject_reason,
)
from callshelf.operators.extract import callables_only, extract_callables, parse_errors
from callshelf.operators import nouns
from callshelf.operators.tags import tag_counts, without_words
from callshelf.plans.ingest import ingest
from callshelf.session import scratch, spread, stage
from callshelf.sources.part_corpus import BASE, FOLDERS, part_corpus, write_tree
from callshelf.sources.store import CatalogStore
from callshelf.sources.tree import exclude_paths
from callshelf.sources.tree_source import read_tree, read_tree_stream
from callshelf.streaming.incremental import read_source_stream, start_ingest

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = datetime(2024, 1, 1, tzinfo=timezone.utc)
# Stated as parameters of the queries; the checking SQL uses the same values.
URL_PATTERNS = ["*.example.org", "fr/", "*7.py", "!*77.py", "m.*/de/**"]
DOCUMENT_BYTES = 4_000
GROUP_BYTES = 1_000
REPORT_K = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- inputs derived from the tables -------------------------------------------------


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages.url`` as file paths: host, language, page, ``.py`` for plain pages."""
    path = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    plain = F.regexp_replace(path, r"/\z", "")
    suffix = F.when(plain.endswith(".html"), "").otherwise(".py")
    return _table(spark, sf_dir, "pages").select("page_id", F.concat(plain, suffix).alias("path"))


def document_entries(spark: SparkSession, sf_dir: str, key: str, text_max_bytes: int) -> DataFrame:
    """Documents as catalog entries, keyed by the id of ``key`` (a SQL expression)."""
    entries = _table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang").alias("path"),
        F.col("doc_id").alias("line_number"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"),
        F.lit("function").alias("type"),
        F.lit("").alias("signature"),
        F.lit("").alias("docstring"),
        F.col("text").alias("source_code"),
        identity.cid(F.expr(key)).alias("cid"),
    )
    return check_constraints(with_code_cid(entries), text_max_bytes=text_max_bytes)


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per document, the whole text as docstring of its function."""
    text = F.replace(F.col("text"), F.lit('"'), F.lit('\\"'))
    return spread(_table(spark, sf_dir, "documents")).select(
        F.concat(
            F.lit("/srv/notes/"), "source", F.lit("/note_"), "doc_id", F.lit(".py")
        ).alias("path"),
        F.concat(
            F.lit("def note_"), "doc_id", F.lit('(lang: str = "'), "lang",
            F.lit('") -> str:\n    """'), text, F.lit('"""\n    return lang\n'),
        ).alias("content"),
    )


def _part_store(spark: SparkSession, sf_dir: str) -> CatalogStore:
    store = CatalogStore.create(spark, scratch(spark, "catalog"))
    ingest(part_corpus(spark, sf_dir), store, base=BASE, as_of=AS_OF).release()
    return store


def _codes_view(store: CatalogStore) -> DataFrame:
    return store.codes().drop("created_at", "updated_at")


def _metadata_view(store: CatalogStore) -> DataFrame:
    return store.metadata().withColumn("tags", F.array_join("tags", ","))


# -- scan and extraction ------------------------------------------------------------


def q_scan_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = url_paths(spark, sf_dir).where(F.col("path").rlike(r"(?s)[^/]\.py\z"))
    return exclude_paths(sources, URL_PATTERNS).select("path").distinct()


def _callables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callables_only(extract_callables(part_corpus(spark, sf_dir)))


def q_extract_callables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _callables(spark, sf_dir).select(
        "path", "line_number", "name", "type", "is_async", "source_code"
    )


def q_scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as files on a mounted folder: read by the source tree data source, parsed."""
    root = scratch(spark, "tree").removeprefix("file://")
    write_tree(part_corpus(spark, sf_dir), root)
    sources = stage(read_tree(spark, [root], recursive=True), "sources")
    # a file has a row of its own beside those of its callables
    return extract_callables(sources).select(
        F.expr(f"substr(path, {len(root) + 2})").alias("path"),
        "line_number",
        "name",
        F.col("error").isNotNull().alias("failed"),
    )


def q_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _callables(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def q_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _callables(spark, sf_dir).select("path", "name", "signature")


def q_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _callables(spark, sf_dir).select("path", "name", "docstring")


def q_decorators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _callables(spark, sf_dir).select(
        "path", "name", F.posexplode("decorators").alias("position", "decorator")
    )


def q_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_errors(extract_callables(part_corpus(spark, sf_dir)))


def q_extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = callables_only(extract_callables(document_corpus(spark, sf_dir)))
    return found.select(
        "path", "name", "type", "signature", "docstring",
        F.length("source_code").alias("source_chars"),
    )


def q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_reject_reason(_callables(spark, sf_dir)).select("path", "name", "reject_reason")


def q_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_reject_reason(_callables(spark, sf_dir))
    return valid_callables(judged).select("path", "line_number", "name", "type")


# -- identifiers, flags, tags -------------------------------------------------------


def q_content_cid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(
        "doc_id", identity.cid(F.col("text")).alias("cid")
    )


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_entries(annotate(extract_callables(part_corpus(spark, sf_dir))))


def q_code_cid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("path", "name", "code_cid")


def q_interface_cid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("file_path", "name", "cid")


def q_is_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_path_facts(_callables(spark, sf_dir), BASE).select("path", "name", "is_test")


def _tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_paths(spark, sf_dir).withColumn("tags", path_tags(F.col("path")))


def q_path_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged_pages(spark, sf_dir).select(
        "page_id", "path", F.array_join("tags", ",").alias("tags")
    )


def q_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_counts(_tagged_pages(spark, sf_dir))


def q_tags_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged_pages(spark, sf_dir).select(
        "page_id", tags_json(F.col("tags")).alias("tags_json")
    )


def q_tags_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as the exact text the catalog's JSON column holds; the words of each document
    serve as tags, for their quotes, accents and other scripts."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return _table(spark, sf_dir, "documents").select(
        "doc_id", tags_json_text(words).alias("tags_json")
    )


def q_word_list_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags without the words of a table: here the languages of the documents."""
    words = _table(spark, sf_dir, "documents").select(F.col("lang").alias("word")).distinct()
    return without_words(_tagged_pages(spark, sf_dir), words, key="page_id").select(
        "page_id", F.array_join("tags", ",").alias("tags")
    )


def q_noun_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the noun guesser learns from the documents: every word with its estimate."""
    model = nouns.learn(_table(spark, sf_dir, "documents"))
    return model.words.join(nouns.estimates(model, model.words), "word")


def q_noun_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the pages that the guesser learned from the documents calls nouns."""
    model = nouns.learn(_table(spark, sf_dir, "documents"))
    tagged = stage(_tagged_pages(spark, sf_dir), "pages")
    kept = without_words(tagged, nouns.non_nouns(model, tagged), key="page_id")
    return kept.select("page_id", F.array_join("tags", ",").alias("tags"))


# -- outcomes -----------------------------------------------------------------------


def q_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text: the first in order is taken, if texts of its size are."""
    entries = stage(document_entries(spark, sf_dir, "text", DOCUMENT_BYTES).drop("source_code"),
                    "documents")
    return oc.resolve_outcomes(entries).select(
        F.col("line_number").alias("doc_id"), "outcome", "immutable_cid"
    )


def q_hot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys for all rows: one entry per language fits first, others follow."""
    entries = stage(document_entries(spark, sf_dir, "lang", GROUP_BYTES).drop("source_code"),
                    "documents")
    return oc.resolve_outcomes(entries, order=("line_number",), hot_rows=50).select(
        F.col("line_number").alias("doc_id"), "outcome", "immutable_cid"
    )


def _labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of the texts that have a label."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = documents.join(
        _table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"
    )
    return labelled.select(identity.cid(F.col("text")).alias("cid")).withColumn(
        "code_cid", F.col("cid")
    )


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, hashed once."""
    return stage(q_content_cid(spark, sf_dir), "incoming")


def q_exists_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oc.split_known(_incoming(spark, sf_dir), _labelled_ids(spark, sf_dir))[0]


def q_exists_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oc.split_known(_incoming(spark, sf_dir), _labelled_ids(spark, sf_dir))[1]


def q_outcomes_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the catalog of labelled ones."""
    entries = stage(document_entries(spark, sf_dir, "text", DOCUMENT_BYTES).drop("source_code"),
                    "documents")
    resolved = oc.resolve_outcomes(entries, _labelled_ids(spark, sf_dir))
    return resolved.groupBy("path", "outcome").agg(F.count(F.lit(1)).alias("n"))


# -- catalog ------------------------------------------------------------------------


def q_upsert_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes_view(_part_store(spark, sf_dir))


def q_upsert_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata_view(_part_store(spark, sf_dir))


def q_bypass_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run over changed bodies, with known interfaces written again."""
    store = _part_store(spark, sf_dir)
    second = part_corpus(spark, sf_dir, revision=2)
    ingest(second, store, bypass=True, base=BASE, as_of=AS_OF).release()
    codes = _codes_view(store).withColumnRenamed("cid", "code_cid")
    return _metadata_view(store).join(codes, "code_cid")


def q_catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _part_store(spark, sf_dir).catalog()
    return catalog.select(
        "file_path", "code_name", "code_type", "signature", "docstring", "version_cid"
    )


def q_store_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _part_store(spark, sf_dir).total()
    return total.select("total", F.format_number("total", 0).alias("shown"))


def _in_first_folders(corpus: DataFrame) -> DataFrame:
    inside = [F.col("path").startswith(f"{BASE}/{folder}/") for folder in FOLDERS[:2]]
    return corpus.where(inside[0] | inside[1])


def q_word_list_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog whose tags lack the words of a table: here those of the part types."""
    words = _table(spark, sf_dir, "part").select(
        F.explode(F.split(F.concat_ws(" ", F.lower("p_type"), F.lit("tools parts")), " ")).alias("word")
    ).distinct()
    store = CatalogStore.create(spark, scratch(spark, "catalog"))
    ingest(part_corpus(spark, sf_dir), store, base=BASE, as_of=AS_OF, words=words).release()
    return _metadata_view(store).select("cid", "file_path", "code_name", "tags")


def q_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run of the second revision against a catalog of half the files of the first."""
    store = CatalogStore.create(spark, scratch(spark, "catalog"))
    ingest(_in_first_folders(part_corpus(spark, sf_dir)), store, base=BASE, as_of=AS_OF).release()
    run = ingest(part_corpus(spark, sf_dir, revision=2), store, dry_run=True, base=BASE)
    return run.preview


def q_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus arrives in two parts; the stream picks up each once."""
    store = CatalogStore.create(spark, scratch(spark, "catalog"))
    arrivals, checkpoint = scratch(spark, "arrivals"), scratch(spark, "stream")
    corpus = stage(
        part_corpus(spark, sf_dir).withColumn("read_error", F.lit(None).cast("string")), "corpus"
    )
    in_first = F.lit(False)
    for folder in FOLDERS[:2]:
        in_first = in_first | F.col("path").startswith(f"{BASE}/{folder}/")
    for part in (corpus.where(in_first), corpus.where(~in_first)):
        part.write.mode("append").parquet(arrivals)
        stream = read_source_stream(spark, arrivals)
        query = start_ingest(stream, store, checkpoint, base=BASE, as_of=AS_OF)
        query.awaitTermination()
    codes = _codes_view(store).withColumnRenamed("cid", "code_cid")
    return _metadata_view(store).join(codes, "code_cid")


def q_tree_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus arrives as files in two parts; a stream over the raw tree takes each file
    once, and a third trigger, with nothing new, adds nothing."""
    store = CatalogStore.create(spark, scratch(spark, "catalog"))
    root = scratch(spark, "tree").removeprefix("file://")
    state, checkpoint = scratch(spark, "tree-state"), scratch(spark, "stream")
    corpus = stage(part_corpus(spark, sf_dir), "corpus")
    in_first = F.lit(False)
    for folder in FOLDERS[:2]:
        in_first = in_first | F.col("path").startswith(f"{BASE}/{folder}/")
    for part in (corpus.where(in_first), corpus.where(~in_first), None):
        if part is not None:
            write_tree(part, root)
        # the tree is the corpus mounted at ``root``: its paths are the corpus's again
        stream = read_tree_stream(spark, root, state, recursive=True).withColumn(
            "path", F.concat(F.lit(BASE), F.expr(f"substr(path, {len(root) + 1})"))
        )
        start_ingest(stream, store, checkpoint, base=BASE, as_of=AS_OF).awaitTermination()
    codes = _codes_view(store).withColumnRenamed("cid", "code_cid")
    return _metadata_view(store).join(codes, "code_cid")


# -- reports ------------------------------------------------------------------------


def q_upload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stage(document_entries(spark, sf_dir, "text", DOCUMENT_BYTES).drop("source_code"),
                    "documents")
    return report.upload_errors(oc.resolve_outcomes(entries))


def q_top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First errors of both kinds: broken files of the corpus, oversized documents."""
    failed = stage(q_parse_errors(spark, sf_dir), "failed")
    return report.error_report(failed, q_upload_errors(spark, sf_dir), k=REPORT_K)


def _first_run(spark: SparkSession, sf_dir: str, limit: int):
    store = CatalogStore.create(spark, scratch(spark, "catalog"))
    return ingest(
        part_corpus(spark, sf_dir), store, base=BASE, as_of=AS_OF,
        limits={"text_max_bytes": limit},
    )


def q_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in which the longer codes do not fit."""
    return _first_run(spark, sf_dir, 150).stats


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run, with the total of its catalog."""
    store = CatalogStore.create(spark, scratch(spark, "catalog"))
    run = ingest(part_corpus(spark, sf_dir), store, base=BASE, as_of=AS_OF,
                 limits={"text_max_bytes": 150})
    return report.summary_lines(run.stats, report.readable_total(store))


def q_summary_without_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report when the catalog cannot be read afterwards: all but the total."""
    store = CatalogStore.create(spark, scratch(spark, "catalog"))
    run = ingest(part_corpus(spark, sf_dir), store, base=BASE, as_of=AS_OF,
                 limits={"text_max_bytes": 150})
    lost = CatalogStore(spark, scratch(spark, "gone"))
    return report.summary_lines(run.stats, report.readable_total(lost))


def q_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of runs with errors: beside some uploads, and without any."""
    some = _first_run(spark, sf_dir, 150).status.withColumn("run", F.lit("some"))
    none = _first_run(spark, sf_dir, 1).status.withColumn("run", F.lit("none"))
    return some.unionByName(none)


QUERIES: dict[str, Query] = {
    name: query for name, query in list(globals().items()) if name.startswith("q_")
}
