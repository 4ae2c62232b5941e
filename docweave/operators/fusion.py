"""Fusion of ranked lists, hybrid search and routing by query type. Lists are tables (query_id, rank, item_id, score)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.queries import query_type
from .lexical import top

RRF_K = 60
#: The strategy of each query type.
ROUTES = {"ExplicitFact": "bm25", "ImplicitFact": "hybrid", "InterpretableRationale": "dense", "HiddenRationale": "dense"}
STRATEGIES = ("bm25", "dense", "hybrid")


def stretched(score: Column, counts: Column | None = None) -> Column:
    """A score stretched to [0, 1] among its query's rows (those that ``counts`` is true of); 1 where they differ by less than 0.0001."""
    q, seen = W.partitionBy("query_id"), score if counts is None else F.when(counts, score)
    lo, hi = F.min(seen).over(q), F.max(seen).over(q)
    return F.when(hi - lo < 0.0001, 1.0).otherwise((score - lo) / (hi - lo))


def min_max(results: DataFrame) -> DataFrame:
    """Scores of each query stretched to [0, 1]; all 1 where they differ by less than 0.0001."""
    return results.withColumn("score", stretched(F.col("score")))


def best_per_item(results: DataFrame) -> DataFrame:
    """The row with the highest score of each (query, item)."""
    order = W.partitionBy("query_id", "item_id").orderBy(F.desc(F.round("score", 9)), *(["rank"] if "rank" in results.columns else []))
    return results.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def weighted(bm25: DataFrame, dense: DataFrame, alpha: float | Column = 0.5, beta: float | Column = 0.5, k: int = 10) -> DataFrame:
    """alpha * min-max BM25 + beta * dense over the full outer join; component scores and origin are kept. Weights may be Columns of the
    queries' ids."""
    left = min_max(best_per_item(bm25)).select("query_id", "item_id", F.col("score").alias("bm25_score"))
    right = best_per_item(dense).select("query_id", "item_id", F.col("score").alias("dense_score"))
    both = left.hint("merge").join(right, ["query_id", "item_id"], "full")
    score = alpha * F.coalesce("bm25_score", F.lit(0.0)) + beta * F.coalesce("dense_score", F.lit(0.0))
    origin = F.when(F.col("dense_score").isNull(), "BM25").when(F.col("bm25_score").isNull(), "Dense").otherwise("Hybrid")
    out = top(both.withColumn("score", score).withColumn("origin", origin), k)
    return out.select("query_id", "rank", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "bm25_score", "dense_score")], "origin")


def reciprocal_rank(*lists: DataFrame, k: int = 10, constant: int = RRF_K) -> DataFrame:
    """Sum of 1 / (constant + rank) over the lists, ranks from 1; other columns of the first list that has the item are kept."""
    if not 1 <= constant <= 200:
        raise ValueError("the constant of reciprocal-rank fusion must lie in 1..200")
    parts = [x.select("query_id", "item_id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    both = reduce(DataFrame.unionAll, parts)
    scored = both.groupBy("query_id", "item_id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score"), F.min("list").alias("first_list"))
    return top(scored, k).select("query_id", "rank", "item_id", F.round("score", 6).alias("score"), "first_list")


def hybrid(bm25: DataFrame, dense: DataFrame, k: int = 10, method: str = "weighted", **options) -> DataFrame:
    """Fuse the two lists, each found with the intermediate k of 20 (100 at most); an empty side is an empty list."""
    if method == "rrf":
        none = F.lit(None)
        out = reciprocal_rank(bm25, dense, k=k, **options).drop("first_list")
        return out.withColumn("bm25_score", none.cast("double")).withColumn("dense_score", none.cast("double")).withColumn("origin", none.cast("string"))
    return weighted(bm25, dense, k=k, **options)


def summary(results: DataFrame, strategy: str, queries: DataFrame, dense: DataFrame | None = None) -> DataFrame:
    """Per query: rows found, rows with a BM25 part, dense rows before they were joined, strategy; queries without rows count 0."""
    found = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("origin").isin("BM25", "Hybrid")).alias("n_bm25"))
    out = queries.select("query_id").join(found.hint("merge"), "query_id", "left")
    if dense is not None:
        out = out.join(dense.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_dense")).hint("merge"), "query_id", "left")
    else:
        out = out.withColumn("n_dense", F.lit(0))
    return out.select("query_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "n_bm25", "n_dense")], F.lit(strategy).alias("strategy"))


def route(queries: DataFrame, override: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries with query_type and strategy, rejected): an override of any case wins over the type's strategy; unknown ones are rejected."""
    q = queries.withColumn("query_type", query_type(F.col("text")))
    routed = F.element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), F.col("query_type"))
    chosen = F.coalesce(F.lower(F.col(override)), routed) if override else routed
    q = q.withColumn("strategy", chosen)
    ok = F.col("strategy").isin(*STRATEGIES)
    return q.where(ok), q.where(~ok).withColumn("reason", F.concat(F.lit("unknown strategy "), F.col("strategy")))


def lenient_strategy(name: Column) -> Column:
    """A named strategy in any case, Dense if it is unknown or missing."""
    found = [F.when(F.lower(name) == s.lower(), s) for s in ("BM25", "Dense", "Hybrid", "Adaptive")]
    return F.coalesce(*found, F.lit("Dense"))


def adaptive(queries: DataFrame, lexical: Callable, dense: Callable, k: int = 10, override: str | None = None, deep: int = 20, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """(query_id, rank, item_id, score, strategy): one lexical run and one dense run for all routes. ``lexical`` and ``dense``: functions of (queries, k).

    Routes are a mask on the two lists: a query of one strategy keeps the first ``k`` of its list, a hybrid one the fusion of the first ``deep`` of both.
    """
    routed, _ = route(queries, override)
    routed = routed.drop(*[c for c in ("rank", "item_id", "score") if c in routed.columns])
    own = routed.select("query_id", "strategy")
    left = lexical(routed.where("strategy <> 'dense'"), max(k, deep)).withColumn("stretched", stretched(F.col("score"), F.col("rank") <= deep))
    right = dense(routed.where("strategy <> 'bm25'"), max(k, deep))
    columns = lambda df, name, *more: df.select("query_id", "item_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"), *more)
    both = columns(left, "bm25", "stretched").hint("merge").join(columns(right, "dense"), ["query_id", "item_id"], "full").join(own.hint("merge"), "query_id")
    mixed = F.col("strategy") == "hybrid"
    part = lambda score, rank: F.coalesce(F.when(F.col(rank) <= deep, F.col(score)), F.lit(0.0))
    fused = alpha * part("stretched", "bm25_rank") + beta * part("dense_score", "dense_rank")
    both = both.where(~mixed | (F.col("bm25_rank") <= deep) | (F.col("dense_rank") <= deep))
    both = both.withColumn("score", F.when(mixed, fused).otherwise(F.coalesce("bm25_score", "dense_score"))).withColumn("_by", F.when(mixed, F.col("score")).otherwise(-F.coalesce("bm25_rank", "dense_rank")))
    return top(both, k, "_by").select("query_id", "rank", "item_id", F.round("score", 6).alias("score"), "strategy")
