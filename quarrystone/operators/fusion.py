"""Reciprocal rank fusion and what follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.config import Settings

#: Up to so many rows of a fused pool are broadcast to the store; beyond, the join shuffles both.
BROADCAST_POOL = 200_000


def rrf(rankings: DataFrame, key: str, settings: Settings | None = None) -> DataFrame:
    """(query_id, key, rrf_score, seen) from rows (query_id, list_id, key, rank).

    Each list adds 1 / (k + rank + 1) with ranks from 0.  ``seen`` is the first place at which the key was met when lists are read
    in order; ties keep that order.
    """
    s = settings or Settings()
    return rankings.groupBy("query_id", key).agg(
        F.sum(F.lit(1.0) / (F.lit(s.rrf_k + 1.0) + F.col("rank"))).alias("rrf_score"),
        F.min(F.struct("list_id", "rank")).alias("seen"),
    )


def fused_topk(rankings: DataFrame, store: DataFrame, key: str, settings: Settings | None = None, n_queries: int | None = None) -> DataFrame:
    """The fused pool joined to the store, scored in 0..1, filtered by the least score and cut to the best ``top_k``.

    ``n_queries``, where it is known, bounds the pool: of few queries it is broadcast, so that the store's texts are not shuffled.
    """
    s = settings or Settings()
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "seen")
    pool = rrf(rankings, key, s).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= s.pool)
    few = n_queries is not None and n_queries * s.pool <= BROADCAST_POOL
    found = (F.broadcast(pool) if few else pool).join(store, key)  # ids that the store lacks drop out
    found = found.withColumn("score", F.least(F.lit(1.0), F.col("rrf_score") / s.rrf_normalizer)).filter(F.col("score") >= s.min_score)
    best = Window.partitionBy("query_id").orderBy("place")
    return found.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= s.top_k).drop("seen", "place")


def merged_pool(rounds: DataFrame, key: str, cap: int) -> DataFrame:
    """The best score of each key over all rounds, at most ``cap`` a query; equal scores keep the earliest round."""
    best = rounds.groupBy("query_id", key).agg(F.max(F.struct(F.col("score"), (-F.col("round")).alias("earlier"))).alias("b"))
    best = best.select("query_id", key, F.col("b.score").alias("score"), (-F.col("b.earlier")).alias("round"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "round", key)
    return best.withColumn("position", F.row_number().over(by)).filter(F.col("position") <= cap)
