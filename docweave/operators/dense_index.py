"""An inverted-list index for vector search: approximate top-k whose candidates are scored exactly.

Centres are fitted on the driver by k-means over directions, on a sample of about ``sample`` vectors, drawn by a hash of the id (the bound is that
parameter); every vector is then assigned to the list of its nearest centre inside tasks. A search asks the ``probes`` nearest lists of each
query; lists are dealt to tasks as :func:`dense.nearest` deals tenants, long ones in parts. ``probes`` is chosen at building
time: the fewest with which ``recall`` of the exact top-k of a sample of queries is found. :func:`dense.nearest` stays the exact form.

Null vectors, and vectors of another dimension than the most frequent one of the sample, are in no list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .dense import matrix, nearest


@dataclass
class Index:
    """Vectors with their list (list_id), the centres, and how many lists a search asks."""

    vectors: DataFrame
    centres: np.ndarray
    probes: int


def directions(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def fit(x: np.ndarray, n: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """``n`` centres of the directions of ``x`` by k-means; a centre that loses all its vectors moves to the vector that fits worst."""
    x = directions(x)
    centres = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        s = x @ centres.T
        own, fits = s.argmax(1), s.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        for i in np.flatnonzero(np.bincount(own, minlength=n) == 0):
            worst = fits.argmin()
            sums[i], fits[worst] = x[worst], np.inf
        centres = directions(sums)
    return centres


def sampled(df: DataFrame, key: str, most: int, total: int, seed: str) -> DataFrame:
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    return df.where(draw < most / max(1, total))


def listed(rows: DataFrame, key: str, vector: str, centres: np.ndarray, n: int, into: str) -> DataFrame:
    """``rows`` of (key, vector, ...) once for each of the ``n`` lists nearest to their vector, nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            b = b.filter(pa.array(np.asarray(b.column(1).value_lengths().fill_null(0)) == c.shape[1]))
            s = directions(matrix(b.column(1))) @ c.T if b.num_rows else np.zeros((0, len(c)))
            best = np.argsort(-s, axis=1, kind="stable")[:, :n]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), best.shape[1]))), pa.array(best.ravel().astype(np.int32)), pa.array(np.tile(np.arange(best.shape[1], dtype=np.int32), b.num_rows))], [key, into, "nth"])

    return rows.select(key, F.col(vector).cast("array<float>").alias(vector)).mapInArrow(run, f"{key} {kind}, {into} int, nth int")


def build(items: DataFrame, lists: int | None = None, sample: int = 20_000, recall: float = 0.95, k: int = 10, asked: int = 200, item: str = "item_id", vector: str = "embedding") -> Index | None:
    """Index all ``items``; ``lists``: how many, by default the square root of the number of items, and at most a twentieth of the sample.

    ``asked`` vectors of the sample are searched exactly to choose the probes.
    """
    total = items.count()
    some = sampled(items, item, sample, total, "centres").select(item, F.col(vector).cast("array<float>").alias("x")).where("x is not null").toArrow()
    lengths = np.asarray(some["x"].combine_chunks().value_lengths()) if some.num_rows else np.zeros(0, int)
    if not len(lengths):
        return None
    some = some.filter(pa.array(lengths == np.bincount(lengths).argmax())).sort_by(item)
    x = matrix(some["x"].combine_chunks())
    n = max(1, min(lists or math.isqrt(total), len(x) // 20 or 1))
    centres = fit(x, n)
    own = listed(items, item, vector, centres, 1, "list_id")
    rows = items.join(own.select(item, "list_id").hint("merge"), item)
    # In which of a query's lists, counted from the nearest, its exact neighbours are.
    queries = sampled(items.select(F.col(item).alias("query_id"), F.col(vector).alias("embedding")), "query_id", asked, total, "asked")
    found = nearest(queries, items, k, item=item, vector=vector).select("query_id", "item_id")
    places = listed(queries, "query_id", "embedding", centres, n, "list_id")
    found = found.join(own.select(F.col(item).alias("item_id"), "list_id").hint("merge"), "item_id").join(places.hint("merge"), ["query_id", "list_id"])
    reached = {r["nth"]: r["count"] for r in found.groupBy("nth").count().collect()}  # at most ``lists`` rows
    shares = np.cumsum([reached.get(i, 0) for i in range(n)]) / max(1, sum(reached.values()))
    probes = int(np.searchsorted(shares, recall) + 1) if reached else n
    return Index(rows, centres, min(n, probes))


def search(queries: DataFrame, index: Index, k: int = 10, metric: str = "cosine", probes: int | None = None, item: str = "item_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, item_id, score) as :func:`dense.nearest` has them, among the items of each query's nearest lists."""
    lists = listed(queries, "query_id", "embedding", index.centres, probes or index.probes, "list_id")
    asked = queries.select("query_id", "embedding").join(lists.select("query_id", "list_id").hint("merge"), "query_id").withColumnRenamed("list_id", "tenant_id")
    return nearest(asked, index.vectors, k, metric, by_tenant=True, item=item, vector=vector, tenant="list_id")
