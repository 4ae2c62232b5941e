"""How the retrieval operators' tables are derived from the given ones, for Spark and (as common table expressions) for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.common import sized, spread
from ..functions.queries import TYPES
from ..operators import chunking, lexical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tenant_id, text, title, owner_id, is_public, updated_at."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.col("source").alias("tenant_id"), "text", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
        (F.col("doc_id") % 150).alias("owner_id"), (F.col("doc_id") % 10 == 0).alias("is_public"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("updated_at"),
    )


DOCS = """docs AS (SELECT doc_id, source AS tenant_id, text, 'doc-' || doc_id AS title, doc_id % 150 AS owner_id, doc_id % 10 = 0 AS is_public,
  make_timestamp((1704067200 + doc_id * 60) * 1000000) AS updated_at FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(spread(documents(spark, sf_dir), "doc_id"))


CHUNKS = r"""cw AS (SELECT doc_id, source AS tenant_id, text, regexp_extract_all(text, '[^ \t\r\n]+[ \t\r\n]*') AS ws FROM documents WHERE text <> ''),
cs AS (SELECT *, len(ws) AS n, unnest(CASE WHEN len(ws) <= 393 THEN [0] ELSE range(0, len(ws) - 98, 295) END) AS s FROM cw),
chunks AS (SELECT tenant_id, doc_id, CAST(s // 295 AS INTEGER) AS chunk_index, sha256(tenant_id || '|' || doc_id || '|' || s // 295) AS chunk_id,
  CASE WHEN n <= 393 THEN text ELSE array_to_string(ws[s + 1:s + 393], '') END AS text,
  CAST(CASE WHEN n <= 393 THEN 0 ELSE length(regexp_extract(text, '^[ \t\r\n]*')) + length(array_to_string(ws[1:s], '')) END AS INTEGER) AS start_index,
  CAST(least(CASE WHEN n <= 393 THEN n ELSE 393 END, n - s) AS INTEGER) AS word_count FROM cs)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text (a benchmark item's), query_type."""
    b = table(spark, sf_dir, "benchmark")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select(F.col("item_id").alias("query_id"), "text", kind.alias("query_type"))


QUERIES = f"""queries AS (SELECT item_id AS query_id, text, {TYPES}[item_id % 4 + 1] AS query_type FROM benchmark)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as retrieval items: item_id, tenant_id, text."""
    return spread(documents(spark, sf_dir).select(F.col("doc_id").alias("item_id"), "tenant_id", "text"), "item_id")


ITEMS = "items AS (SELECT doc_id AS item_id, source AS tenant_id, text FROM documents)"


def bm25_sql(name: str = "bm25", k: int = 10, b: float = 0.75, items: str = "items", queries: str = "queries", by_tenant: bool = False, k1: float = 1.2) -> str:
    """Common table expressions that end in ``name`` (query_id, rank, item_id, score)."""
    p = name
    t = "tenant_id, " if by_tenant else ""
    return rf"""{p}_t AS (SELECT item_id, tenant_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ts FROM {items}),
{p}_p AS (SELECT item_id, tenant_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT item_id, tenant_id, len(ts) AS dl, unnest(ts) AS term FROM {p}_t) GROUP BY item_id, tenant_id, term),
{p}_s AS (SELECT count(*) AS n, avg(coalesce(len(ts), 0)) AS avgdl FROM {p}_t),
{p}_d AS (SELECT term, count(*) AS df FROM {p}_p GROUP BY term),
{p}_q AS (SELECT query_id, {t}term, count(*) AS qtf FROM (SELECT query_id, {t}unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM {queries}) GROUP BY ALL),
{p}_r AS (SELECT query_id, item_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))) AS score
  FROM {p}_q JOIN {p}_p USING ({t}term) JOIN {p}_d USING (term), {p}_s GROUP BY query_id, item_id),
{name} AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM {p}_r) WHERE rank <= {k})"""


def lexical_results(spark: SparkSession, sf_dir: str, k: int = 10, **options) -> DataFrame:
    return lexical.bm25(queries(spark, sf_dir), items(spark, sf_dir), k, **options)


def results_with_text(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """BM25 rows with the item's text and source."""
    r = lexical_results(spark, sf_dir, k)
    return r.join(items(spark, sf_dir).withColumnRenamed("tenant_id", "source").hint("merge"), "item_id")


RESULTS = f"""{QUERIES}, {ITEMS}, {bm25_sql()},
results AS (SELECT b.*, i.text, i.tenant_id AS source FROM bm25 b JOIN items i USING (item_id))"""


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("tenant_id"), "embedding")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").cast("string").alias("tenant_id"), "embedding")


def nearest_sql(name: str = "near", k: int = 10, score: str = "list_cosine_similarity(q.e, v.e)", by_tenant: bool = False, order: str = "DESC", where: str = "", shown: str = "round(score, 6)") -> str:
    return f"""{name}_v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
{name} AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, {shown} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) {order}, item_id) AS rank FROM
  (SELECT q.vec_id AS query_id, v.vec_id AS item_id, {score} AS score FROM {name}_v q JOIN {name}_v v ON {'q.label = v.label' if by_tenant else 'true'} WHERE q.vec_id % 20 = 0 {where})) WHERE rank <= {k})"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer_id, answer, query, context of assistant turns: the turn before is the query, neighbouring turns are the context."""
    c = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("query", F.coalesce(F.lag("text").over(w), F.lit(""))).withColumn("context", F.concat_ws(" ", F.lag("text", 2).over(w), F.lag("text").over(w), F.lead("text").over(w)))
    answer = F.concat("text", F.lit(" [Source "), (F.col("turn") + 1).cast("string"), F.lit("]"))
    return c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), answer.alias("answer"), "query", "context")


ANSWERS = """answers AS (SELECT conv_id * 1000 + turn AS answer_id, text || ' [Source ' || (turn + 1) || ']' AS answer, query, context FROM
  (SELECT *, coalesce(lag(text) OVER w, '') AS query, concat_ws(' ', lag(text, 2) OVER w, lag(text) OVER w, lead(text) OVER w) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'assistant')"""


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "labels")
    return g.select("doc_id", (F.col("doc_id") * 7 % 150).alias("user_id"), (1 + F.col("quality") + F.col("toxic")).cast("int").alias("permission"), F.lit(0).cast("long").alias("granted_by"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("granted_at"))


GRANTS = """grants AS (SELECT doc_id, doc_id * 7 % 150 AS user_id, CAST(1 + quality + toxic AS INTEGER) AS permission, make_timestamp((1704067200 + doc_id * 60) * 1000000) AS granted_at FROM labels)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access requests of events' users: user, document (dealt over all documents, and some ids beyond them), tenant (every second time the
    document's own) and the level that is needed."""
    e = table(spark, sf_dir, "events")
    d = table(spark, sf_dir, "documents")
    n = d.agg((F.max("doc_id") + 20).alias("n"))  # one row
    e = e.crossJoin(F.broadcast(n)).withColumn("doc_id", F.col("event_id") * 7919 % F.col("n"))
    e = e.join(d.select("doc_id", "source").hint("merge"), "doc_id", "left")
    tenant = F.when(F.col("event_id") % 2 == 0, F.col("source")).otherwise(F.concat(F.lit("src"), F.col("event_id") % 20))
    return e.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 150).alias("user_id"), "doc_id", tenant.alias("tenant_id"), (1 + F.col("event_id") % 3).cast("int").alias("needed"), F.col("ts").alias("at"))


REQUESTS = """requests AS (SELECT event_id AS request_id, user_id % 150 AS user_id, e.doc_id, CASE WHEN event_id % 2 = 0 THEN source ELSE 'src' || event_id % 20 END AS tenant_id, CAST(1 + event_id % 3 AS INTEGER) AS needed, ts AS "at"
  FROM (SELECT *, event_id * 7919 % (SELECT max(doc_id) + 20 FROM documents) AS doc_id FROM events) e LEFT JOIN documents d ON d.doc_id = e.doc_id)"""


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, item_id) where the document holds the benchmark item's text.

    A document that holds an item holds its longest inner word between spaces: that word finds the candidates, and ``contains`` decides.
    Items of fewer than three words have no inner word and are looked for in every document.
    """
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    inner = F.expr("filter(split(needle, ' '), (x, i) -> i > 0 and i < size(split(needle, ' ')) - 1)")
    b = b.withColumn("word", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))["word"])
    d = items(spark, sf_dir).select("item_id", "text")
    words = d.select("item_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    found = words.join(sized(b.where("word is not null")), "word").select("query_id", "item_id", "needle")
    long = found.join(d.hint("merge"), "item_id").where(F.contains("text", "needle"))
    short = d.join(sized(b.where("word is null")), F.contains(F.col("text"), F.col("needle")))
    return long.select("query_id", "item_id").unionAll(short.select("query_id", "item_id")).distinct()


QRELS = "qrels AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id AS item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
