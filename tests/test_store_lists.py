"""Postings as pages by blocks of items, compaction table by table, and what stays where it is."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.operators import lexical, store
from docweave.sources import segments

from .test_store import docs, fresh, put, queries, stored


def brute(chunks, term="terms"):
    rows = chunks.select("chunk_id", F.explode(lexical.terms(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return sorted(map(tuple, rows.collect()))


@pytest.fixture
def blocks(monkeypatch):
    monkeypatch.setattr(store, "ITEMS", 64)


def test_postings_are_pages(spark, tmp_path, blocks):
    path, rows = str(tmp_path), docs(spark, range(300)).coalesce(1).withColumn("text", F.when(F.col("doc_id") % 50 == 7, "... -- !").otherwise(F.concat("text", F.lit(" Żółw żółw "), "doc_id")))
    put(spark, path, rows)
    lists = segments.rows(spark, path, "postings")
    items, post = store.live(spark, path, "items"), store.live_postings(spark, path)
    assert items.count() > 5 * 64 and lists.count() < post.count() / 3  # it was a row for each posting
    chunks = store.live(spark, path, "chunks")
    assert sorted(map(tuple, post.join(items.select("item_id", *store.NUMBER), store.NUMBER).select("item_id", "term", "tf").collect())) == brute(chunks)
    want = chunks.select(F.col("chunk_id").alias("item_id"), F.size(lexical.terms(F.col("text"))).alias("dl"), F.size(F.array_distinct(lexical.terms(F.col("text")))).alias("n_terms"))
    assert sorted(map(tuple, items.select("item_id", "dl", "n_terms").collect())) == sorted(map(tuple, want.collect())) and items.where("dl = 0").count() == 6
    assert stored(spark, path) == fresh(spark, rows)


def test_dead_items_leave_the_pages(spark, tmp_path, blocks):
    path = str(tmp_path)
    put(spark, path, docs(spark, range(200)).coalesce(1))
    put(spark, path, docs(spark, range(150, 260), n=30).coalesce(2))
    store.delete_documents(path, spark.createDataFrame([(i,) for i in range(0, 260, 3)], "doc_id long"))
    now = docs(spark, range(150)).unionAll(docs(spark, range(150, 260), n=30)).where("doc_id % 3 <> 0")
    held = lambda df: sorted((r["term"], r["origin"], r["no"], r["tf"]) for r in df.select("term", "origin", "no", "tf").collect())
    at = segments.state(spark, path)
    left = held(store.live_postings(spark, path))
    assert left == held(store.unpacked(store.live_pages(spark, path, at).where(F.col("bucket") < store.BUCKETS)))
    for by_tenant in (False, True):
        assert stored(spark, path, by_tenant=by_tenant) == fresh(spark, now, by_tenant=by_tenant) != []
    store.compact(spark, path)
    assert left == held(store.unpacked(segments.rows(spark, path, "postings").where(F.col("bucket") < store.BUCKETS))) and stored(spark, path) == fresh(spark, now)


def test_many_asked_terms_give_the_same(spark, tmp_path, monkeypatch):
    put(spark, str(tmp_path), docs(spark, range(12)))
    few = stored(spark, str(tmp_path))
    monkeypatch.setattr(store, "few_rows", lambda df: (None, False))
    assert stored(spark, str(tmp_path)) == few != []


def test_one_table_at_a_time_is_there_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    put(spark, path, docs(spark, range(12)))
    store.delete_documents(path, spark.createDataFrame([(3,)], "doc_id long"))
    commit, seen = segments._commit, []

    def watched(spark, path, segment, base, schemas):
        (name,) = schemas  # one table for each commit
        seen.append(name)
        assert all(os.listdir(f"{path}/{n}") == [f"segment={segment}"] for n in seen[:-1])
        commit(spark, path, segment, base, schemas)

    monkeypatch.setattr(segments, "_commit", watched)
    store.compact(spark, path)
    assert seen == ["postings", "documents", "chunks", "items", "vectors"] and stored(spark, path) == fresh(spark, docs(spark, [i for i in range(12) if i != 3]))


def test_a_compaction_that_stops_half_way_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    put(spark, path, docs(spark, range(12)))
    store.delete_documents(path, spark.createDataFrame([(3,)], "doc_id long"))
    want = stored(spark, path)

    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(segments, "settled", stopped)
        store.compact(spark, path)
    assert stored(spark, path) == want == fresh(spark, docs(spark, [i for i in range(12) if i != 3]))
    put(spark, path, docs(spark, [3]))
    store.compact(spark, path)
    assert stored(spark, path) == fresh(spark, docs(spark, range(12)))


def test_settled_rows_are_the_newest(spark, monkeypatch):
    rows = [(k, s, s == 3 and k == "b", f"{k}{s}") for k in ["a", "b", "c", "d", None] for s in range(1, 4) if not (k in ("a", "d") and s != 2)] + [("e", 1, True, "e1")]
    found = spark.createDataFrame(rows, "k string, segment long, deleted boolean, text string")
    out = lambda df: sorted(map(str, df.select("k", "segment", "text").collect()))
    want = out(segments.newest(found, "k"))
    assert out(segments.settled(found, "k")) == want and len(want) == 4
    monkeypatch.setattr(segments, "within", lambda df: (None, False))
    assert out(segments.settled(found, "k")) == want


def test_shuffles_go_with_their_write(spark, tmp_path):
    put(spark, str(tmp_path), docs(spark, range(12)))
    status = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = status()
    put(spark, str(tmp_path / "b"), docs(spark, range(12)))
    assert status() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_tombstones_hold_no_texts(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, docs(spark, range(12)))
    store.delete_documents(path, spark.createDataFrame([(3,), (4,)], "doc_id long"))
    for name, column in (("documents", "text"), ("chunks", "text"), ("vectors", "payload")):
        assert segments.rows(spark, path, name).where("deleted").agg(F.count(F.lit(1)), F.count(column)).first()[1] == 0


def test_plain_texts_are_cut_as_spark_does(spark):
    rng = random.Random(3)
    signs = [chr(c) for c in range(lexical.PLAIN) if c != 0x130]
    rows = ["", "_", "a", *signs, *("".join(rng.choice(signs if i % 2 else "aB \n_9é.") for _ in range(rng.randint(0, 60))) for i in range(1500))]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    want = [r["ts"] for r in df.select(lexical.terms(F.col("text")).alias("ts")).collect()]
    lengths, found = lexical.cutter()(pa.array(rows))
    found, ends = found.to_pylist(), np.append(0, np.cumsum(lengths))
    assert [found[ends[i] : ends[i + 1]] for i in range(len(rows))] == want
    odd = ["İ", "aɐ", "ẞ", "Σ", "\U0001f422", "x\n中"]
    assert spark.createDataFrame([(t,) for t in odd], "text string").where(F.rlike("text", F.lit(lexical.NOT_PLAIN))).count() == len(odd)
    assert df.where(F.rlike("text", F.lit(lexical.NOT_PLAIN))).count() == 0


def test_texts_that_are_not_plain(spark, tmp_path):
    ends = ["İstanbul ΣΑΣ σας", "中文 x", "plain Żółw", "\U0001f422 \U00010428x ẞ"]
    rows = docs(spark, range(24)).withColumn("text", F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, ends)), (F.col("doc_id") % 4 + 1).cast("int"))))
    put(spark, str(tmp_path), rows)
    post, items = store.live_postings(spark, str(tmp_path)), store.live(spark, str(tmp_path), "items")
    got = post.join(items.select("item_id", *store.NUMBER), store.NUMBER).select("item_id", "term", "tf")
    assert sorted(map(tuple, got.collect())) == brute(store.live(spark, str(tmp_path), "chunks"))
