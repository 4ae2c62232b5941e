"""The pipeline on a small table against brute force, and the registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import TABLES, rows
from docweave.llm import entries, sentencepieces

from .test_operators_llm import classes, corpus, lower, make


def test_stages(spark, tmp_path):
    docs = make(spark, corpus()).drop("label")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, before, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
        now.write.parquet(str(tmp_path / str(len(counts))))
        now = spark.read.parquet(str(tmp_path / str(len(counts))))
        counts.append(now.collect())
        if len(counts) == 1:
            assert {r["doc_id"] for r in counts[0]} >= {i for i, t, *_ in corpus() if t and len(t) > 100}
            assert not any(not (r["text"] or "").strip() for r in counts[0])
        if len(counts) == 2:
            best = {}
            for r in counts[0]:
                best[lower(r["text"])] = max(r["doc_id"], best.get(lower(r["text"]), -1))
            assert {r["doc_id"] for r in counts[1]} == set(best.values())
        if len(counts) == 3:
            assert {r["doc_id"] for r in counts[2]} == {d for d, _, _, kept in classes([(r["doc_id"], r["text"]) for r in counts[1]], 5, 80) if kept}
    assert len(counts[3]) == len(counts[4]) and {r["doc_id"] for r in counts[4]} == {r["doc_id"] for r in counts[3]}
    model, text = sentencepieces.load(), {r["doc_id"]: r["text"] for r in counts[3]}
    import numpy as np

    assert all(model.decode(np.array(r["ids"])) == text[r["doc_id"]] for r in counts[4])


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and entry.queries()["pipeline"] is corpus_pipeline.run


def test_empty(spark, tmp_path):
    make(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    assert rows(entries.QUERIES[name](spark, data).toPandas()) == rows(con.execute(entries.ORACLE_SQL[name]).df())
