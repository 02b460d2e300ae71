"""Compare registered queries with their SQL. Run: python tests/check.py [sf] [query ...]"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

_SPARK_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "BOOLEAN": "boolean", "DOUBLE": "double"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def compare(spark, connection, sf_dir: str, query, sql: str) -> str | None:
    """None if both give the same bag of rows, else what differs."""
    df = query(spark, sf_dir)
    ours = Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} here, {sorted(columns)} expected"
    types = {c[0]: _SPARK_TYPES.get(str(c[1]), str(c[1])) for c in result.description}
    other = {n: (t, types[n]) for n, t in df.dtypes if types[n] != t}
    if other:
        return f"types here and expected: {other}"
    order = [columns.index(c) for c in sorted(columns)]
    expected = Counter(tuple(r[i] for i in order) for r in result.fetchall())
    if ours != expected:
        return (
            f"{ours.total()} rows here, {expected.total()} expected\n"
            f"  only here:     {list((ours - expected).items())[:2]}\n"
            f"  only expected: {list((expected - ours).items())[:2]}"
        )
    return None


def main() -> int:
    import __spark_entry__ as contract
    from callshelf.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = duck(sf_dir), 0
    oracles = contract.oracle_sql()
    for name, query in contract.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.perf_counter()
        problem = compare(spark, connection, sf_dir, query, oracles[name])
        failed += problem is not None
        print(f"{name:22} {time.perf_counter() - start:6.1f}s {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
