"""Exact top-k inner products by the no-random-access algorithm.

Each dimension of a block of candidates is a list sorted by value. A query reads the lists
in turn from the end that its weight makes the best, some entries at a time. What was read
of a candidate is a lower bound when its unread lists count at the worst value there is, and
an upper bound when they count at the last values read. Reading stops once no candidate
outside the k best lower bounds can reach them, and the final scores of those that
could be among the best are resolved.

Queries and candidates meet in blocks of bounded size; each pair of blocks is one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callshelf.session import stage

K = 5
SCALE = 256
QUERY_EVERY = 50
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
#: The bounds are looked at after each of so many parts of the lists.
ROUNDS = 8
#: Queries of a block whose bounds are held at a time.
QUERY_BATCH = 128


class SortedLists:
    """The lists of a block: candidates by value, ascending, for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, order, axis=0).T.astype(float)
        # the place of each candidate in each list
        self.places = np.argsort(order, axis=0, kind="stable")

    def best(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and scores of the best ``k`` other candidates, best first.

        All queries read their lists to the same depth, from above where the weight is
        positive and from below where it is negative, and look at their bounds there.
        """
        n = len(self.ids)
        others = self.ids[:, None] != query_ids
        above = np.maximum(queries, 0).astype(float)
        below = np.minimum(queries, 0).astype(float)
        low, high = self.values[:, 0], self.values[:, -1]
        # Bounds are sums of doubles. Where those might not be exact, all is read.
        largest = np.abs(queries).max(axis=0).astype(float) * np.maximum(np.abs(low), np.abs(high))
        open_ = np.arange(len(query_ids)) if largest.sum() < 2**52 and n > k else np.arange(0)
        left: dict[int, np.ndarray] = {}
        vectors = self.vectors.astype(float)
        for read in range(1, ROUNDS):
            end = n * read // ROUNDS
            if not len(open_) or not end:
                continue
            from_above, from_below = self.places >= n - end, self.places < end
            seen = np.hstack([vectors * from_above, vectors * from_below])
            unread = np.hstack([~from_above, ~from_below]).astype(float)
            up, down = above[open_], below[open_]
            known = seen @ np.hstack([up, down]).T
            last = np.hstack([up * self.values[:, n - end], down * self.values[:, end - 1]])
            upper = known + unread @ last.T
            lower = known + unread @ np.hstack([up * low, down * high]).T
            apart = others[:, open_]
            bar = np.partition(np.where(apart, lower, -np.inf), n - k, axis=0)[n - k]
            reach = (upper >= bar) & apart
            done = reach.sum(axis=0) <= max(4 * k, n // 64)
            for i in np.flatnonzero(done):
                left[int(open_[i])] = np.flatnonzero(reach[:, i])
            open_ = open_[~done]
        found = []
        for i, query in enumerate(queries):
            chosen = left.get(i)
            chosen = np.flatnonzero(others[:, i]) if chosen is None else chosen
            final = self.vectors[chosen] @ query
            first = np.lexsort((self.ids[chosen], -final))[:k]
            found.append((self.ids[chosen][first], final[first]))
        return found


def integer_vectors(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, dims, v)`` with ``floor(scale * x)`` of each component. Vectors that are
    null, empty, or hold a null, NaN or infinite component are left out."""
    real = F.transform(F.col(vector), lambda x: x.cast("double"))
    # null components make the test null, so they fail it too
    finite = F.forall(
        real, lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    )
    whole = F.transform(real, lambda x: F.floor(x * scale).cast("bigint"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull())
    return rows.where((F.size(vector) > 0) & finite & ~F.isnan(F.coalesce(
        F.element_at(real, 1), F.lit(float("nan"))))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.size(vector).alias("dims"), whole.alias("v")
    )


def top_k(
    vectors: DataFrame,
    *,
    k: int = K,
    scale: int = SCALE,
    query_every: int = QUERY_EVERY,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best other rows of each query.

    Queries are the rows whose id ``query_every`` divides. Ties go to the smaller id. Vectors
    without id, and those that ``integer_vectors`` leaves out, take no part; only vectors of
    one length are compared; scores are 64-bit sums. Rows that repeat an id are candidates
    each and one query, and never answer that query. Other columns play no part. An empty
    table gives an empty result.
    """
    rows = stage(integer_vectors(vectors, scale=scale), "vectors")
    is_query = F.pmod("vec_id", F.lit(query_every)) == 0
    sizes = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_query).alias("queries")).first()
    c_blocks = max(1, -(-sizes["all"] // candidate_block))
    q_blocks = max(1, -(-sizes["queries"] // query_block))
    queries = (
        rows.where(is_query)
        .groupBy("vec_id")
        .agg(F.min(F.struct("dims", "v")).alias("s"))
        .select(
            "vec_id", "s.dims", "s.v",
            F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int").alias("q"),
            F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c"),
        )
    )
    candidates = rows.select(
        "vec_id", "dims", "v",
        F.pmod(F.xxhash64("vec_id"), F.lit(c_blocks)).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"),
    )

    def search(asking: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({n: np.empty(0, np.int64) for n in ("query_id", "vec_id", "score")})]
        if len(asking) and len(asked):
            lists = SortedLists(asked["vec_id"].to_numpy(), np.stack(asked["v"].to_numpy()))
            query_ids, queries = asking["vec_id"].to_numpy(), np.stack(asking["v"].to_numpy())
            for start in range(0, len(query_ids), QUERY_BATCH):
                batch = slice(start, start + QUERY_BATCH)
                best = lists.best(query_ids[batch], queries[batch], k)
                for query_id, (ids, scores) in zip(query_ids[batch], best):
                    rows = {"query_id": query_id, "vec_id": ids, "score": scores}
                    found.append(pd.DataFrame(rows))
        return pd.concat(found)

    keys = ("q", "c", "dims")
    found = (
        queries.groupBy(*keys)
        .cogroup(candidates.groupBy(*keys))
        .applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
