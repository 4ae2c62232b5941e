"""Exact vector top-k over a table of query vectors, and the vector table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.common import sized
from .lexical import PLACES, top

METRICS = ("cosine", "euclid", "dot")
#: Queries and items (about) that one task multiplies.
BLOCK, PART = 2000, 20_000
#: Scores that a task holds at once (about six arrays of 8 bytes each).
CELLS = 1 << 19


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def similarity(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """query x item scores; of euclid the distance."""
    if metric == "dot":
        return q @ x.T
    if metric == "euclid":
        return np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T))
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    return np.divide(q @ x.T, norms, out=np.zeros(norms.shape), where=norms > 0)


def products(q: pa.Table, v: pa.Table, k: int, metric: str) -> list[pa.Table]:
    """(query_id, item_id, score) of the first ``k`` items of each query; queries are taken in slices, so that no more than about CELLS scores are held."""
    found, items = [], matrix(v["x"].combine_chunks())
    step = max(1, min(256, CELLS // v.num_rows))
    for lo in range(0, q.num_rows, step):
        part = q.slice(lo, step)
        raw = similarity(metric, matrix(part["x"].combine_chunks()), items)
        s = np.round(raw if metric == "euclid" else -raw, PLACES)
        n = min(k, s.shape[1])
        edge = np.partition(s, n - 1, axis=1)[:, n - 1 : n]  # ties at the edge all stay
        qi, xi = np.nonzero((s <= edge) & np.isfinite(s))
        hits = pa.table({"q": qi, "query_id": part["query_id"].take(pa.array(qi)), "item_id": v["item_id"].take(pa.array(xi)), "s": s[qi, xi], "score": raw[qi, xi]})
        hits = hits.sort_by([("q", "ascending"), ("s", "ascending"), ("item_id", "ascending")])
        qs = np.asarray(hits["q"])
        found.append(hits.select(["query_id", "item_id", "score"]).filter(pa.array(np.arange(len(qs)) - np.searchsorted(qs, qs) < k)))
    return found


def _dealt(rows: DataFrame, sizes: DataFrame, key: str, mine: str, others: str, order: bool) -> DataFrame:
    """``rows`` (t, ...) with the group (g, tg, b, p) of each task that needs them: once for each of the ``others`` parts, in their own of ``mine`` parts."""
    rows = rows.join(sizes, "t")
    own = F.pmod(F.xxhash64(key, F.lit(mine)), F.col(mine)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
    return rows.select("*", own.alias("b" if order else "p"), every.alias("p" if order else "b")).drop("blocks", "parts")


def nearest(queries: DataFrame, items: DataFrame, k: int = 10, metric: str = "cosine", by_tenant: bool = False, item: str = "item_id", vector: str = "embedding", tenant: str = "tenant_id", most_k: int = 100, places: int | None = 6) -> DataFrame:
    """(query_id, rank, item_id, score) of ``queries`` (query_id, embedding[, tenant_id]); unknown metrics count as cosine.

    One job, whatever the number of queries: queries are dealt into blocks of about BLOCK and items into parts of about PART; each pair of a
    block and a part is one product inside a task, which keeps its own top k of every query; and a window takes the final ones. What is
    shuffled is every query once for each part and every item once for each block, never a pair. Items of another dimension never
    match. ``places``: decimals of the score; None leaves it unrounded.

    ``by_tenant``: tenants are dealt apart, so that only vectors of one tenant are multiplied: a large one has blocks and parts of its own, small ones
    share tasks. A query id may come with several tenants; its top k is taken over all of them.
    """
    metric, k, ascending = metric if metric in METRICS else "cosine", min(k, most_k), metric == "euclid"
    kind, q_kind = items.schema[item].dataType, queries.schema["query_id"].dataType
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    own = lambda c: F.col(c).cast("string") if by_tenant else F.lit("")
    asked = queries.select(own("tenant_id").alias("t"), "query_id", none(kind, "item_id"), F.lit(True).alias("asks"), F.col("embedding").cast("array<float>").alias("x"))
    rows = items.select(own(tenant).alias("t"), none(q_kind, "query_id"), F.col(item).alias("item_id"), F.lit(False).alias("asks"), F.col(vector).cast("array<float>").alias("x"))
    few = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    if by_tenant:
        n = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("t").agg(F.count(F.lit(1)).alias("q")).hint("merge"), "t")
        tasks = max(1, -(-(n.agg(F.sum("n")).first()[0] or 0) // PART))
        small = (F.col("n") <= PART) & (F.col("q") <= BLOCK)
        group = [F.when(small, F.pmod(F.xxhash64("t"), F.lit(tasks))).otherwise(-1).cast("int").alias("g"), F.when(~small, F.col("t")).otherwise("").alias("tg")]
        sizes = sized(n.select("t", *group, few("q", BLOCK).alias("blocks"), few("n", PART).alias("parts")))
    else:
        counts = [(queries.count(), BLOCK), (items.count(), PART)]
        blocks, parts = (max(1, -(-n // size)) for n, size in counts)
        sizes = F.broadcast(queries.sparkSession.range(1).select(F.lit("").alias("t"), F.lit(0).alias("g"), F.lit("").alias("tg"), F.lit(blocks).alias("blocks"), F.lit(parts).alias("parts")))
    dealt = _dealt(rows, sizes, "item_id", "parts", "blocks", False).unionByName(_dealt(asked, sizes, "query_id", "blocks", "parts", True))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t").combine_chunks()
        ts, length = np.asarray(table["t"].combine_chunks().dictionary_encode().indices), np.asarray(table["x"].combine_chunks().value_lengths().fill_null(0))
        cuts = np.flatnonzero(np.append(True, ts[1:] != ts[:-1])) if len(ts) else []
        found = []
        for lo, hi in zip(cuts, [*cuts[1:], len(ts)]):
            mine, sizes, asks = table.slice(lo, hi - lo), length[lo:hi], np.asarray(table["asks"].slice(lo, hi - lo))
            for size in np.unique(sizes[asks]):  # queries meet items of their own dimension
                q, v = mine.filter(pa.array(asks & (sizes == size))).combine_chunks(), mine.filter(pa.array(~asks & (sizes == size))).combine_chunks()
                if size and v.num_rows:
                    found += products(q, v, k, metric)
        return pa.concat_tables(found) if found else table.schema.empty_table().select(["query_id", "item_id"]).append_column("score", pa.array([], pa.float64()))

    out = dealt.groupBy("g", "tg", "b", "p").applyInArrow(run, f"query_id {q_kind.simpleString()}, item_id {kind.simpleString()}, score double")
    score = F.col("score") if places is None else F.round("score", places)
    return top(out, k, ascending=ascending).select("query_id", "rank", "item_id", score.alias("score"))


def normalized(cosine: Column) -> Column:
    """(cosine + 1) / 2, kept inside [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine + 1) / 2))


def dense(queries: DataFrame, items: DataFrame, k: int = 10, threshold: float = 0.5, second: float | None = None, **options) -> DataFrame:
    """Cosine top-k whose normalised scores reach ``threshold`` (and the caller's ``second``); applied after the top k, so fewer rows are right."""
    rows = nearest(queries, items, k, places=None, **options).withColumn("score", F.round(normalized(F.col("score")), 6))
    return rows.where(F.col("score") >= max(threshold, second or 0.0))


def check_vectors(vectors: DataFrame, dimension: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by dimension; null vectors are rejected."""
    ok = F.coalesce(F.size(vector) == dimension, F.lit(False))
    return vectors.where(ok), vectors.where(~ok)


def upsert(stored: DataFrame, new: DataFrame, key: str = "item_id", version: str = "version") -> DataFrame:
    """Both tables as one with the latest version of each key; of equal versions the new row wins."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = W.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "_new")
