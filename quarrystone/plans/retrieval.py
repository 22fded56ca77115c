"""Retrieval plans: dense, sparse and hybrid modes with degradation, and the iterated search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.config import Settings
from quarrystone.operators import bm25
from quarrystone.operators.dense import nearest
from quarrystone.operators.fusion import fused_topk, merged_pool
from quarrystone.session import checkpoint_dir


def retrieve(corpus: DataFrame, vectors: DataFrame | None, queries: DataFrame, query_vectors: DataFrame | None, key: str, order: str, settings: Settings | None = None, index: bm25.Index | None = None) -> DataFrame:
    """(query_id, key, score, position, stage) of the best documents, from a stored BM25 index where one is given.

    Without vectors, hybrid search degrades to the sparse ranking (stage ``sparse_fallback``) and dense search finds nothing.
    ``vectors`` has (vec_id, key, embedding), ``queries`` (query_id, text), ``query_vectors`` (query_id, embedding).
    """
    s = settings or Settings()
    lists = []
    dense_ok = vectors is not None and query_vectors is not None
    if s.mode != "sparse" and dense_ok:
        near = nearest(vectors, query_vectors, s.pool).join(vectors.select("vec_id", key), "vec_id")
        lists.append(near.select("query_id", F.lit(0).alias("list_id"), key, "rank"))
    if s.mode != "dense":
        sparse = bm25.search(index, queries, s.pool, settings=s) if index else bm25.bm25_topk(corpus, queries, s.pool, key, order, settings=s)
        lists.append(sparse.select("query_id", F.lit(1).alias("list_id"), key, "rank"))
    if not lists:
        empty = queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, list_id int, {key} {corpus.schema[key].dataType.simpleString()}, rank int")
        lists.append(empty)
    rankings = lists[0]
    for more in lists[1:]:
        rankings = rankings.unionByName(more)
    stage = s.mode if s.mode != "hybrid" or dense_ok else "sparse_fallback"
    return fused_topk(rankings, corpus.select(key).distinct(), key, s).select("query_id", key, "score", "position", F.lit(stage).alias("stage"))


def deep_retrieve(search: Callable[[DataFrame], DataFrame], queries: DataFrame, expand: Callable[[DataFrame, DataFrame], DataFrame], key: str, settings: Settings | None = None) -> tuple[DataFrame, list[str]]:
    """Search, widen, search again; each query for itself.

    Each round searches with all texts so far of the queries that are still open and merges into a pool by the best score.  A
    query ends when its best of the round is good enough, after the last round, without a budget for new texts, or when
    ``expand`` (texts, pool) adds nothing new for it; at most ``deep_queries`` new texts are taken for a query and round.  A search that
    fails fails the whole, whatever rounds went before: what they found is no result of all rounds.

    Returns (query_id, key, score, position, rounds, stopped) of the best of the pool, and why each round ended: widened, or the
    reason of the last query.  Rounds are checkpointed, so the plan does not grow with them.
    """
    s = settings or Settings()
    checkpoint_dir(queries.sparkSession)  # where the rounds are checkpointed
    ids = queries.select("query_id").distinct()
    pool, stops, texts, reasons = None, None, queries.select("query_id", "text"), []

    def stop(some: DataFrame, round_: int, reason: str) -> None:
        nonlocal stops
        told = some.select("query_id", F.lit(round_ + 1).alias("rounds"), F.lit(reason).alias("stopped"))
        stops = told if stops is None else stops.unionByName(told)

    open_ = ids
    for round_ in range(s.deep_iterations):
        found = search(texts).select("query_id", key, "score").withColumn("round", F.lit(round_))
        merged = found if pool is None else pool.select("query_id", key, "score", "round").unionByName(found)
        pool = merged_pool(merged, key, s.deep_pool).checkpoint()
        best = found.groupBy("query_id").agg(F.max("score").alias("best")).filter(F.col("best") >= s.deep_good_score).select("query_id").checkpoint()
        stop(open_.join(best, "query_id", "left_semi"), round_, "good_enough")
        open_ = open_.join(best, "query_id", "left_anti").checkpoint()
        reason = "good_enough" if open_.isEmpty() else "max_iterations" if round_ == s.deep_iterations - 1 else "no_budget_for_queries" if s.deep_queries < 1 else "widened"
        if reason == "widened":
            asked = texts.join(open_, "query_id", "left_semi")
            new = expand(asked, pool).select("query_id", "text").join(texts, ["query_id", "text"], "left_anti").distinct()
            first = Window.partitionBy("query_id").orderBy("text")  # a query's own texts
            new = new.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= s.deep_queries).drop("nth").checkpoint()
            stop(open_.join(new, "query_id", "left_anti"), round_, "no_new_queries")
            open_ = open_.join(new, "query_id", "left_semi").checkpoint()
            texts = asked.join(open_, "query_id", "left_semi").unionByName(new).checkpoint()
            reason = "no_new_queries" if open_.isEmpty() else reason
        elif reason != "good_enough":
            stop(open_, round_, reason)
        reasons.append(reason)
        if reason != "widened":
            break
    best = pool.filter((F.col("score") >= s.min_score) & (F.col("position") <= s.top_k))
    return best.join(stops, "query_id", "left").select("query_id", key, "score", "position", "rounds", "stopped"), reasons


def retrieve_auto(plain: Callable[[DataFrame], DataFrame], deep: Callable[[DataFrame], DataFrame], queries: DataFrame, deep_by_default: bool = False) -> DataFrame:
    """Plain or deep results (query_id, ...), query by query: its ``deep`` flag where it has one, else the default."""
    flag = F.coalesce(F.col("deep"), F.lit(deep_by_default)) if "deep" in queries.columns else F.lit(deep_by_default)
    told = queries.withColumn("deep", flag)
    parts = [run(told.filter(F.col("deep") == kind).drop("deep")).withColumn("deep", F.lit(kind)) for run, kind in ((plain, False), (deep, True))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)
