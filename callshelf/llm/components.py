"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callshelf.session import stage


#: Tables of as many rows or fewer are broadcast, others joined by a shuffle.
BROADCAST_ROWS = 500_000


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` (a narrow table) with a broadcast hint if it is small enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def stage_narrow(df: DataFrame, name: str, rows: int, per_task: int = 200_000) -> DataFrame:
    """Stage a table of narrow rows in as many files as it is worth. It is made from about
    ``rows`` rows, of which a task should take ``per_task``."""
    return stage(df.coalesce(max(12, rows // per_task)), name)


def components(links: DataFrame, rows: int) -> DataFrame:
    """``(vertex, root)`` of every vertex of ``links(a, b)``, about ``rows`` of them; a
    component has one root.

    In each round every vertex points to the neighbour of least hash, or itself, and the
    links are drawn between what their ends point to. Hashes make a chain shrink by a
    fraction in each round whatever its order. Neighbours are reduced map-side, so a vertex
    with very many links is no burden. No links give no rows.
    """

    def rank(vertex: str):
        return F.struct(F.xxhash64(vertex).alias("h"), F.col(vertex).alias("v"))

    open_links = stage_narrow(links.select("a", "b").where("a <> b"), "links", rows)
    rounds = []
    while left_over := open_links.count():
        both = open_links.select("a", "b").unionByName(
            open_links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        )
        points = stage_narrow(
            both.groupBy("a")
            .agg(F.min(rank("b")).alias("other"))
            .select(
                F.col("a").alias("vertex"),
                F.least(F.col("other"), rank("a"))["v"].alias("to"),
            ),
            "points",
            2 * left_over,
        )
        rounds.append(points)
        few = bounded(points)
        left = few.select(F.col("vertex").alias("a"), F.col("to").alias("_a"))
        right = few.select(F.col("vertex").alias("b"), F.col("to").alias("_b"))
        open_links = stage_narrow(
            open_links.join(left, "a")
            .join(right, "b")
            .where("_a <> _b")
            .select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            .distinct(),
            "links",
            left_over,
        )
    if not rounds:
        return open_links.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    roots = rounds[0].withColumnRenamed("to", "root")
    for points in rounds[1:]:
        moved = bounded(points.withColumnRenamed("vertex", "root"))
        roots = roots.join(moved, "root", "left").select(
            "vertex", F.coalesce("to", "root").alias("root")
        )
    return stage_narrow(roots, "roots", 2 * rows)
