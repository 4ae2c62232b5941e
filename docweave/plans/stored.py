"""Queries over the stored catalogue: upserts, deletes, compaction and re-indexing. Each fills a new shared folder and reads it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.common import spread
from ..operators import intake, reindex, store
from ..session import scratch, written
from . import text as T
from .fixtures import CHUNKS, QUERIES as QS, bm25_sql, documents, grants, queries, table


def embedder(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """Chunks to vector rows: vector i stands for the first chunk of document i."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")

    def make(chunks: DataFrame) -> DataFrame:
        found = chunks.where("chunk_index = 0").join(e.hint("merge"), "doc_id")
        return store.vector_rows(found, F.lit("embeddings"), {"label": F.col("label"), "wordCount": F.col("word_count")})

    return make


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("hash", intake.fingerprint(F.col("text")))
    return intake.new_hashes(d).withColumnRenamed("document_id", "doc_id")


def filled(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A store of all documents with their hashes, vectors and grants."""
    path = scratch(spark, name)
    store.put_documents(spark, path, spread(documents(spark, sf_dir), "doc_id"), embedded=embedder(spark, sf_dir), more={"hashes": hashes(spark, sf_dir), "grants": grants(spark, sf_dir)})
    return path


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")


def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete the documents that labels call toxic: removed and left rows of each table."""
    path = filled(spark, sf_dir, "delete")
    removed = store.delete_documents(path, toxic(spark, sf_dir))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("left")).select(F.lit(name).alias("table"), "left")
    left = count(store.live_postings(spark, path), "postings")
    for name in store.KEYS:
        left = left.unionAll(count(store.live(spark, path, name), name))
    return removed.join(left.hint("merge"), "table")


_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
M4 = rf"""WITH {CHUNKS}, g AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
a AS (SELECT 'documents' AS "table", doc_id FROM documents UNION ALL SELECT 'chunks', doc_id FROM chunks UNION ALL SELECT 'items', doc_id FROM chunks
  UNION ALL SELECT 'postings', doc_id FROM (SELECT DISTINCT chunk_id, doc_id, unnest({_TERMS}) AS term FROM chunks)
  UNION ALL SELECT 'vectors', doc_id FROM chunks JOIN embeddings ON vec_id = doc_id WHERE chunk_index = 0
  UNION ALL SELECT 'hashes', min(doc_id) FROM documents GROUP BY source, sha256(text) UNION ALL SELECT 'grants', doc_id FROM labels)
SELECT "table", count(*) FILTER (doc_id IN (SELECT doc_id FROM g)) AS removed, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM g)) AS "left" FROM a GROUP BY ALL"""


def m4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored BM25 after the delete, from tombstones and once they are compacted."""
    path = filled(spark, sf_dir, "delete-search")
    store.delete_documents(path, toxic(spark, sf_dir))
    before = written(store.bm25(queries(spark, sf_dir), path).withColumn("state", F.lit("deleted")), "found")  # before the old segments go
    store.compact(spark, path)
    return before.unionAll(store.bm25(queries(spark, sf_dir), path).withColumn("state", F.lit("compacted")))


M4_SEARCH = f"""WITH {CHUNKS}, items AS (SELECT chunk_id AS item_id, tenant_id, text FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {QS}, {bm25_sql()}
SELECT *, unnest(['deleted', 'compacted']) AS state FROM bm25"""


def s6_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in three overlapping batches; what the first one says of documents that come again is outdated."""
    path = scratch(spark, "upsert")
    d = documents(spark, sf_dir)
    part = F.col("doc_id") % 3
    store.put_documents(spark, path, d.where(part < 2).withColumn("text", F.when(part == 1, F.concat("text", F.lit(" an outdated end "), "text")).otherwise(F.col("text"))))
    store.put_documents(spark, path, d.where(part > 0))
    store.put_documents(spark, path, d.where(part == 2))
    return store.bm25(queries(spark, sf_dir), path)


S6_UPSERT = f"WITH {CHUNKS}, items AS (SELECT chunk_id AS item_id, tenant_id, text FROM chunks), {QS}, {bm25_sql()} SELECT * FROM bm25"


def s7_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with payload in two upserts, the second of every third vector, negated; the whole payload is read back."""
    path = scratch(spark, "vectors")
    c = store.chunk(spread(documents(spark, sf_dir), "doc_id")).where("chunk_index = 0")
    rows = embedder(spark, sf_dir)(c)
    store.put_vectors(spark, path, rows, 64)
    store.put_vectors(spark, path, rows.where("doc_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)), 64)
    back = store.live(spark, path, "vectors")
    p = F.col("payload")
    return back.select(
        "item_id", "tenant_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), p["documentId"].alias("document_id"), p["tenantId"].alias("payload_tenant"), F.md5(p["text"]).alias("text_md5"),
        p["source"].alias("source"), p["startIndex"].alias("start_index"), p["endIndex"].alias("end_index"), p["chunkIndex"].alias("chunk_index"), p["metadata_label"].alias("label"), p["metadata_wordCount"].alias("words"), F.size(p).alias("n_fields"),
    )


_VECTORS = "SELECT c.*, e.label, e.embedding FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id WHERE chunk_index = 0"
S7_TABLE = f"""WITH {CHUNKS}, v AS ({_VECTORS})
SELECT chunk_id AS item_id, tenant_id, round(list_sum(CAST(embedding AS DOUBLE[])) * CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END, 5) AS total, CAST(doc_id AS VARCHAR) AS document_id, tenant_id AS payload_tenant, md5(text) AS text_md5,
  'embeddings' AS source, CAST(start_index AS VARCHAR) AS start_index, CAST(start_index + length(text) AS VARCHAR) AS end_index, '0' AS chunk_index, CAST(label AS VARCHAR) AS label, CAST(word_count AS VARCHAR) AS words, CAST(9 AS INTEGER) AS n_fields FROM v"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which one in nine has no text, and one in nine none after cleaning."""
    d = spread(documents(spark, sf_dir), "doc_id")
    return d.withColumn("text", F.when(F.col("doc_id") % 9 == 0, "  \n").when(F.col("doc_id") % 9 == 1, "Signature").otherwise(F.col("text")))


_RAW = "d AS (SELECT doc_id, source, CASE WHEN doc_id % 9 = 0 THEN '  ' || chr(10) WHEN doc_id % 9 = 1 THEN 'Signature' ELSE text END AS t FROM documents), " + T._clean_ctes("d")
_KEPT = f"kept AS (SELECT doc_id, source, cleaned AS text FROM c4 JOIN c1 USING (doc_id) JOIN d USING (doc_id) WHERE {T._TRIM.format('raw')} <> '' AND cleaned <> '')"
TENANT = "src1"


def n5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows of all tenants and of one."""
    path, d = scratch(spark, "reindex"), _raw(spark, sf_dir)
    runs = [reindex.reindex(spark, d, path, T.ENGLISH, tenant, embedder(spark, sf_dir)) for tenant in (None, TENANT)]
    return runs[0].unionAll(runs[1]).select(F.coalesce("tenant_id", F.lit("all")).alias("tenant_id"), "estimated", "processed", "status")


N5 = f"""WITH {_RAW}, {_KEPT} SELECT s AS tenant_id, CAST((SELECT count(*) FROM documents WHERE s = 'all' OR source = s) AS INTEGER) AS estimated, CAST((SELECT count(*) FROM kept WHERE s = 'all' OR source = s) AS INTEGER) AS processed,
  'Completed' AS status FROM unnest(['all', '{TENANT}']) AS u(s)"""


def n5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by tenant after the catalogue was filled from raw documents, one tenant was cleaned anew, and nothing else was touched."""
    path = filled(spark, sf_dir, "reindex-tables")
    reindex.reindex(spark, _raw(spark, sf_dir), path, T.ENGLISH, TENANT, embedder(spark, sf_dir))
    out = None
    for name, df in [(n, store.live(spark, path, n)) for n in ("documents", "chunks", "vectors")] + [("postings", store.live_postings(spark, path))]:
        n = df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "tenant_id", "n")
        out = n if out is None else out.unionAll(n)
    return out


N5_TABLES = rf"""WITH {_RAW}, {_KEPT}, now AS (SELECT doc_id, source, text FROM kept WHERE source = '{TENANT}' UNION ALL SELECT doc_id, source, text FROM documents WHERE source <> '{TENANT}'), {CHUNKS.replace('FROM documents', 'FROM now')}
SELECT 'documents' AS "table", source AS tenant_id, count(*) AS n FROM now GROUP BY source UNION ALL SELECT 'chunks', tenant_id, count(*) FROM chunks GROUP BY tenant_id
UNION ALL SELECT 'vectors', tenant_id, count(*) FROM ({_VECTORS}) GROUP BY tenant_id
UNION ALL SELECT 'postings', tenant_id, count(*) FROM (SELECT DISTINCT chunk_id, tenant_id, unnest({_TERMS}) AS term FROM chunks) GROUP BY tenant_id"""

QUERIES = {"m4_cascade_delete": m4, "m4_search_after_delete": m4_search, "s6_index_upsert": s6_upsert, "s7_vector_table": s7_table, "n5_reindex": n5, "n5_reindexed_tables": n5_tables}
ORACLE_SQL = {"m4_cascade_delete": M4, "m4_search_after_delete": M4_SEARCH, "s6_index_upsert": S6_UPSERT, "s7_vector_table": S7_TABLE, "n5_reindex": N5, "n5_reindexed_tables": N5_TABLES}
