"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the tables. BENCH_CPUS: local threads. BENCH_QUERIES: names,
separated by commas, or ``all``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_content_cid",
    "q_extract_callables",
    "q_extract_documents",
    "q_validate",
    "q_code_cid",
    "q_interface_cid",
    "q_path_tags",
    "q_scan_exclude",
    "q_dedup_first_wins",
    "q_hot_groups",
    "q_exists_new",
    "q_upsert_codes",
    "q_upsert_metadata",
    "q_bypass_upsert",
    "q_incremental",
    "q_run_stats",
]
EXTRA = ["q_noun_tags", "q_tree_stream", "q_summary", "q_tags_json_text"]
#: Operators of the optional ``llm`` subpackage, timed when it is there.
OPERATORS = ["op11_secrets", "op12_conv_trie", "op13_merkle", "op1_sharding", "op6_url_filter"]


def main() -> None:
    from callshelf.plans.queries import QUERIES
    from callshelf.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not chosen else list(QUERIES) if chosen == "all" else chosen.split(",")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the engine, an Arrow worker and the readers of all tables before timing.
    spark.range(1000).mapInArrow(lambda batches: batches, "id long").selectExpr("sum(id)").collect()
    for table in ("documents", "pages", "part", "labels"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.format("noop").mode("overwrite").save()

    def timed(queries: dict, chosen: list[str]) -> dict[str, float]:
        spent = {}
        for name in chosen:
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent[name] = round(time.perf_counter() - start, 3)
        return spent

    seconds = timed(QUERIES, names)
    extra = timed(QUERIES, EXTRA) if not chosen else {}
    try:
        from callshelf.llm.queries import QUERIES as OPERATOR_QUERIES
    except ImportError:
        OPERATOR_QUERIES = {}
    operators = timed(OPERATOR_QUERIES, [n for n in OPERATORS if n in OPERATOR_QUERIES]) \
        if not chosen else {}
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "extra": extra,
                "operators": operators,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
