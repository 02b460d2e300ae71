"""Registered queries of the operators, and their checking SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callshelf.llm.bpe import round_trip_digests
from callshelf.llm.common import table
from callshelf.llm.conv_trie import conversation_trie
from callshelf.llm.merkle import merkle_manifest
from callshelf.llm.lm_score import score_documents as lm_score_documents
from callshelf.llm.near_dedup import near_duplicates
from callshelf.llm.packing import pack_documents
from callshelf.llm.quality import quality_report
from callshelf.llm.secrets import find_secrets, span_text
from callshelf.llm.sharding import shard_documents
from callshelf.llm.surrogates import replace_entities
from callshelf.llm.topk import top_k
from callshelf.llm.toxicity import score_documents as toxicity_score_documents
from callshelf.llm.url_filter import judge_urls

#: The key of the registered query; a user's own belongs in a secret store.
SURROGATE_KEY = "registered query"

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score_documents(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(table(spark, sf_dir, "documents"))
    return report.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).drop("url")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    replaced = replace_entities(documents, SURROGATE_KEY, count_column="n_replaced")
    return replaced.select("doc_id", "text", "n_replaced")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
        count("entropy").alias("n_entropy"),
    )


def op12_conv_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    name: query for name, query in list(globals().items()) if name.startswith("op")
}

_OP6 = """
WITH cut AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0
        THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), rules(verdict, rule_host, rule_path) AS (VALUES
    ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM parts JOIN rules
        ON ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""

_OP3 = """
WITH whole AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, vec_id, score,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP5 = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i
        FROM split WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT x, y FROM common JOIN sizes i ON i.doc_id = x JOIN sizes j ON j.doc_id = y
    WHERE 100 * c >= 75 * (i.n + j.n - c)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT x AS doc_id, coalesce(max(n), 0) AS n_shingles, min(y) AS component_id, x = min(y) AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = x GROUP BY x
"""

ORACLES: dict[str, str] = {"op3_topk": _OP3, "op5_near_dedup": _OP5, "op6_url_filter": _OP6}
