"""Vector search by tenant and by the inverted-list index."""

import numpy as np
import pyarrow as pa
import pytest

from docweave.operators import dense, dense_index
from docweave.plans import retrieval


def brute(q, v, k):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(v).T, 6)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("block, part", [(2000, 20_000), (3, 7)])
def test_tenants_are_dealt_apart(spark, monkeypatch, block, part):
    """One large tenant and many small ones: each query meets its own tenant's vectors, and no product is made of others."""
    monkeypatch.setattr(dense, "BLOCK", block)
    monkeypatch.setattr(dense, "PART", part)
    rng = np.random.default_rng(3)
    v, tenant = rng.normal(size=(260, 6)), np.array(["big"] * 150 + [f"t{i % 22}" for i in range(110)])
    rows = [(i, str(tenant[i]), v[i].tolist()) for i in range(260)] + [(900, "big", [1.0, 2.0]), (901, "big", None), (902, None, v[0].tolist())]
    items = spark.createDataFrame(rows, "item_id long, tenant_id string, embedding array<double>")
    queries = items.selectExpr("item_id AS query_id", "tenant_id", "embedding").where("item_id % 3 = 0")
    got = {}
    for r in dense.nearest(queries, items, 4, by_tenant=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    for q in range(0, 260, 3):
        own = np.flatnonzero(tenant == tenant[q])
        assert [i for _, i in sorted(got[q])] == own[brute(v[q : q + 1], v[own], 4)[0]].tolist()
    assert got.keys() == {*range(0, 260, 3), 900}  # null vectors and null tenants match nothing
    assert dense.nearest(queries.limit(0), items, 4, by_tenant=True).count() == dense.nearest(queries, items.limit(0), 4, by_tenant=True).count() == 0


@pytest.mark.parametrize("clusters, n", [(40, 4000), (0, 2500)])
def test_recall_of_the_index(spark, clusters, n):
    rng = np.random.default_rng(clusters)
    v = rng.normal(size=(n, 16)) + (3 * rng.normal(size=(clusters, 16))[rng.integers(0, clusters, n)] if clusters else 0)
    items = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())] + [(n + 1, None), (n + 2, [1.0])], "item_id long, embedding array<double>").cache()
    index = dense_index.build(items, recall=0.97, asked=300, sample=2000)
    queries = items.selectExpr("item_id AS query_id", "embedding").where("item_id % 20 = 0")
    got = dense_index.search(queries, index).collect()
    asked = np.arange(0, n, 20)
    want = {(int(q), int(i)) for q, row in zip(asked, brute(v[asked], v, 10)) for i in row}
    found = {(r["query_id"], r["item_id"]) for r in got}
    assert len(found & want) >= 0.9 * len(want) and index.vectors.count() == n
    assert index.probes < len(index.centres) or not clusters
    scores = {(r["query_id"], r["item_id"]): r["score"] for r in dense.nearest(queries, items).collect()}
    assert all(abs(scores[q, i] - s) < 1e-6 for q, i, s in ((r["query_id"], r["item_id"], r["score"]) for r in got) if (q, i) in scores)
    every = dense_index.search(queries, index, probes=len(index.centres))
    assert {(r["query_id"], r["item_id"]) for r in every.collect()} == want


def test_recall_of_the_query(spark, data):
    exact = {(r["query_id"], r["item_id"]) for r in retrieval.r4(spark, data).collect()}
    found = {(r["query_id"], r["item_id"]) for r in retrieval.r4_indexed(spark, data).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_index_of_nothing(spark):
    assert dense_index.build(spark.createDataFrame([], "item_id long, embedding array<float>")) is None


def test_scores_of_a_full_block_are_held_in_slices(monkeypatch):
    """A task of 2,000 queries and 20,000 items holds CELLS scores at once, not 256 times 20,000."""
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(300, 3)).astype(np.float32), rng.normal(size=(20_000, 3)).astype(np.float32)
    rows = lambda name, x: pa.table({name: np.arange(len(x)), "x": pa.array(list(x), pa.list_(pa.float32()))})
    cells, similarity = [], dense.similarity
    monkeypatch.setattr(dense, "similarity", lambda m, a, b: cells.append(len(a) * len(b)) or similarity(m, a, b))
    got = pa.concat_tables(dense.products(rows("query_id", q), rows("item_id", v), 5, "dot"))
    assert max(cells) <= dense.CELLS and sum(cells) == 300 * 20_000
    want = np.argsort(-(q.astype(float) @ v.astype(float).T), axis=1)[:, :5]
    assert np.asarray(got["item_id"]).reshape(300, 5).tolist() == want.tolist()
