"""The stored catalogue: upserts, deletes, failing writes, compaction."""

import os

import pytest
from pyspark.sql import functions as F

from docweave.operators import cleaning, lexical, reindex, store
from docweave.sources import segments

WORDS = "red green blue black white grey pink gold".split()


def text(i, n=40):
    return " ".join(WORDS[(i * k + k // 3) % 8] for k in range(n))


def docs(spark, ids, n=40, tenant=2):
    return spark.createDataFrame([(f"t{i % tenant}", i, text(i, n)) for i in ids], "tenant_id string, doc_id long, text string")


def embedded(chunks):
    v = chunks.withColumn("embedding", F.array(F.length("text").cast("float"), F.col("chunk_index").cast("float")))
    return store.vector_rows(v, F.lit("file"), {"words": F.col("word_count"), "none": F.lit(None).cast("string")})


def queries(spark):
    return spark.createDataFrame([(1, "t0", "red green red"), (2, "t1", "gold"), (3, "t1", "none")], "query_id long, tenant_id string, text string")


def fresh(spark, rows, **options):
    """BM25 over what should be stored, without a store."""
    chunks = store.chunk(rows, 20, 5).withColumnRenamed("chunk_id", "item_id")
    return sorted(map(tuple, lexical.bm25(queries(spark), chunks, **options).collect()))


def stored(spark, path, **options):
    return sorted(map(tuple, store.bm25(queries(spark), path, **options).collect()))


def put(spark, path, rows, **options):
    return store.put_documents(spark, path, rows, embedded=embedded, size=20, overlap=5, **options)


def test_upserts_deletes_and_compaction(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, docs(spark, range(12)))
    put(spark, path, docs(spark, range(6, 18), n=90))  # longer: more chunks
    put(spark, path, docs(spark, range(9, 12), n=8))  # shorter: chunks must go
    now = docs(spark, range(6)).unionAll(docs(spark, [6, 7, 8, *range(12, 18)], n=90)).unionAll(docs(spark, range(9, 12), n=8))
    for by_tenant in (False, True):
        assert stored(spark, path, by_tenant=by_tenant) == fresh(spark, now, by_tenant=by_tenant) != []
    n_chunks = store.chunk(now, 20, 5).count()
    assert [store.live(spark, path, t).count() for t in ("documents", "chunks", "items", "vectors")] == [18, n_chunks, n_chunks, n_chunks]

    removed = {r["table"]: r["removed"] for r in store.delete_documents(path, spark.createDataFrame([(3,), (10,), (99,), (3,), (None,)], "doc_id long")).collect()}
    gone = store.chunk(now.where("doc_id in (3, 10)"), 20, 5)
    assert removed == {"documents": 2, "chunks": gone.count(), "items": gone.count(), "vectors": gone.count(), "postings": store.posting_rows(gone, "chunk_id").count()}
    left = now.where("doc_id not in (3, 10)")
    assert stored(spark, path) == fresh(spark, left)

    before = {t: sorted(map(str, store.live(spark, path, t).drop("segment").collect())) for t in ("documents", "chunks", "items", "vectors")}
    number = store.compact(spark, path)
    assert os.listdir(f"{path}/postings") == [f"segment={number}"] and stored(spark, path) == fresh(spark, left)
    assert before == {t: sorted(map(str, store.live(spark, path, t).drop("segment").collect())) for t in before}
    put(spark, path, docs(spark, [3]))
    assert stored(spark, path) == fresh(spark, left.unionAll(docs(spark, [3])))


def test_payload(spark, tmp_path):
    put(spark, str(tmp_path), docs(spark, [4]))
    row = store.live(spark, str(tmp_path), "vectors").where("payload['chunkIndex'] = '1'").first()
    chunk = store.chunk(docs(spark, [4]), 20, 5).where("chunk_index = 1").first()
    assert row["payload"] == {"documentId": "4", "tenantId": "t0", "text": chunk["text"], "source": "file", "startIndex": str(chunk["start_index"]), "endIndex": str(chunk["end_index"]), "chunkIndex": "1", "metadata_words": str(chunk["word_count"])}
    assert row["embedding"] == [len(chunk["text"]), 1.0]


def test_vectors_of_a_wrong_dimension_are_not_stored(spark, tmp_path):
    v = spark.createDataFrame([("a", 1, "t", [1.0, 2.0], {"k": "v"}), ("b", 2, "t", [1.0], {})], "item_id string, doc_id long, tenant_id string, embedding array<float>, payload map<string,string>")
    store.put_vectors(spark, str(tmp_path), v.where("item_id = 'a'"), 2)
    with pytest.raises(ValueError, match="vector b"):
        store.put_vectors(spark, str(tmp_path), v, 2)
    store.put_vectors(spark, str(tmp_path), v.where("item_id = 'a'").withColumn("embedding", F.array(F.lit(5.0), F.lit(6.0)).cast("array<float>")), 2)
    assert [(r["item_id"], r["embedding"]) for r in store.live(spark, str(tmp_path), "vectors").collect()] == [("a", [5.0, 6.0])]


def test_a_failing_write_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, docs(spark, range(4)))
    want = stored(spark, path)

    def broken(chunks):
        return embedded(chunks).withColumn("item_id", F.raise_error(F.lit("no model")).cast("string"))

    for run in (lambda: reindex.reindex(spark, docs(spark, range(4), n=70), path, cleaning.Rules(), "t1", broken), lambda: store.put_documents(spark, path, docs(spark, range(4), n=70), embedded=broken, size=20, overlap=5)):
        with pytest.raises(Exception, match="no model"):
            run()
        assert stored(spark, path) == want and segments.state(spark, path).last == 1
    put(spark, path, docs(spark, range(4), n=70))  # the next writer replaces what the failed ones left
    assert stored(spark, path) == fresh(spark, docs(spark, range(4), n=70))


def test_reindex_replaces_a_tenant(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, docs(spark, range(8)), more={"grants": spark.createDataFrame([(1, 5), (2, 5)], "doc_id long, user_id long")})
    raw = docs(spark, range(2, 8), n=20).withColumn("text", F.when(F.col("doc_id") == 3, " \n").otherwise(F.col("text")))
    run = reindex.reindex(spark, raw, path, cleaning.Rules(), "t1", embedded).first()
    assert (run["tenant_id"], run["estimated"], run["processed"], run["status"]) == ("t1", 3, 2, "Completed")
    assert sorted(r["doc_id"] for r in store.live(spark, path, "documents").collect()) == [0, 2, 4, 5, 6, 7]
    assert sorted({r["doc_id"] for r in store.live(spark, path, "vectors").collect()}) == [0, 2, 4, 5, 6, 7]
    run = reindex.reindex(spark, raw, path, cleaning.Rules(), embedded=embedded).first()
    assert (run["estimated"], run["processed"]) == (6, 5) and sorted(r["doc_id"] for r in store.live(spark, path, "chunks").collect()) == [2, 4, 5, 6, 7]


def test_nothing_written(spark, tmp_path):
    with pytest.raises(ValueError):
        store.bm25(queries(spark), str(tmp_path))
    with pytest.raises(ValueError):
        store.live(spark, str(tmp_path), "chunks")
    put(spark, str(tmp_path), docs(spark, []))
    assert stored(spark, str(tmp_path)) == [] and store.live(spark, str(tmp_path), "documents").count() == 0


def test_postings_do_not_repeat_chunk_ids(spark, tmp_path):
    """Chunk ids of 64 characters stay out of postings, through upserts and compaction."""
    path = str(tmp_path)
    put(spark, path, docs(spark, range(4)))
    put(spark, path, docs(spark, range(2, 6)))
    store.compact(spark, path)
    assert "item_id" not in store.live_postings(spark, path).columns
    assert store.live_postings(spark, path).count() == store.posting_rows(store.chunk(docs(spark, range(6)), 20, 5), "chunk_id").count()
    assert stored(spark, path) == fresh(spark, docs(spark, range(6)))
