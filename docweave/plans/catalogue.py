"""All registered queries of the retrieval operators, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import answers as context
from ..operators import lexical
from . import answers, catalog, evaluation, jobs, retrieval, stored, text
from .fixtures import CHUNKS, QUERIES as QS, bm25_sql, chunks, queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (text, retrieval, answers, catalog, evaluation, jobs, stored):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks to BM25 top ten for every benchmark query to packed contexts: (query_id, context, n_sources)."""
    c = chunks(spark, sf_dir).withColumnRenamed("chunk_id", "item_id")
    found = lexical.bm25(queries(spark, sf_dir), c)
    texts = c.select("item_id", "text", c["tenant_id"].alias("source"))
    return context.assemble(found.join(texts.hint("merge"), "item_id").drop("rank"))


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = f"""WITH {CHUNKS}, items AS (SELECT chunk_id AS item_id, tenant_id, text FROM chunks), {QS}, {bm25_sql()},
rel AS (SELECT * FROM (SELECT b.query_id, b.item_id, b.score, i.text, i.tenant_id AS source, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM bm25 b JOIN items i USING (item_id)) WHERE score >= 0.3 OR rank = 1),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY rank) AS rn FROM rel) WHERE rn = 1), {answers._pack_sql('dd', 2700)} SELECT * FROM pk"""
