"""Queries of the jobs that write tables: sinks, re-indexing and streams. Each writes to a new shared folder and reads it back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.common import spread
from ..operators import cleaning, intake, lexical
from ..session import scratch
from ..sources import files
from ..streaming import jobs
from . import catalog, evaluation, retrieval
from .fixtures import CHUNKS, chunks, documents, queries, relevance, table

STREAM = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sink")
    files.write_documents(documents(spark, sf_dir), chunks(spark, sf_dir), path)
    count = lambda name: spark.read.parquet(f"{path}/{name}").groupBy("tenant_id").agg(F.count(F.lit(1)).alias(name))
    return count("documents").join(count("chunks").hint("merge"), "tenant_id")


S5 = f"WITH {CHUNKS} SELECT tenant_id, any_value(d.n) AS documents, count(*) AS chunks FROM chunks JOIN (SELECT source AS tenant_id, count(*) AS n FROM documents GROUP BY 1) d USING (tenant_id) GROUP BY tenant_id"


def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up exported and read back: metrics from the JSON, counts and latencies from the CSV, both by the time in their names."""
    csv, json = files.write_results(evaluation.rolled(spark, sf_dir), scratch(spark, "results"), evaluation.METRICS, datetime(2024, 1, 2, 3, 4, 5))
    flat = spark.read.option("header", True).csv(csv).select("strategy", "query_type", F.col("n").cast("long").alias("n"), F.col("p95_ms").cast("double").alias("p95_ms"))
    nested = spark.read.schema("strategy string, query_type string, precision struct<At5: double, At10: double>, recall struct<At5: double, At10: double>, mrr double").json(json)
    rows = nested.join(flat.hint("merge"), ["strategy", "query_type"]).withColumn("file", F.lit(csv.rpartition("/")[2]))
    return rows.select("strategy", "query_type", F.col("precision.At5").alias("p_at_5"), F.col("precision.At10").alias("p_at_10"), F.col("recall.At5").alias("r_at_5"), F.col("recall.At10").alias("r_at_10"), F.col("mrr").alias("rr"), "n", "p95_ms", "file")


S8 = f"{evaluation.E5.replace('SELECT * FROM rolled', '')} SELECT strategy, query_type, p_at_5, p_at_10, r_at_5, r_at_10, rr, n, CAST(p95_ms AS DOUBLE) AS p95_ms, 'results_2024-01-02_03-04-05.csv' AS file FROM rolled"


def s3_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation set written as JSON files, one object each, and read back; some relevance rows name items that are not there."""
    path = scratch(spark, "evaluation-set")
    item = F.when(F.col("query_id") % 4 == 0, -F.col("item_id") - 1).otherwise(F.col("item_id")).cast("string")
    rel = relevance(spark, sf_dir).groupBy("query_id").agg(F.collect_list(item).alias("relevantDocIds"))
    qs = queries(spark, sf_dir).join(rel.hint("merge"), "query_id", "left")
    bucket = lambda c: (F.col(c) % SETS).cast("int").alias("bucket")
    q = F.struct(F.col("query_id").cast("string").alias("id"), "text", F.coalesce("relevantDocIds", F.array().cast("array<string>")).alias("relevantDocIds"), F.col("query_type").alias("queryType"))
    d = documents(spark, sf_dir).select(bucket("doc_id"), F.struct(F.col("doc_id").cast("string").alias("id"), F.col("title").alias("text"), F.col("tenant_id").alias("source")).alias("d"))
    sets = d.groupBy("bucket").agg(F.collect_list("d").alias("documents")).join(qs.groupBy(bucket("query_id")).agg(F.collect_list(q).alias("queries")).hint("merge"), "bucket", "left")
    sets.repartitionById(SETS, F.col("bucket")).select("documents", "queries").write.json(path)
    found, asked, qrels = files.read_evaluation_set(spark, path)
    ok, without, dangling = evaluation.E.check_set(asked, qrels, found)
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), "query_id")
    return part(ok, "usable").unionAll(part(without, "without")).unionAll(part(dangling, "dangling"))


#: Files of the evaluation set.
SETS = 8
S3_FILE = f"SELECT kind, CAST(query_id AS VARCHAR) AS query_id FROM ({evaluation.S3})"


def r1_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks are indexed once, and the queries are answered from the stored tables."""
    path = scratch(spark, "index")
    lexical.write_index(chunks(spark, sf_dir), path, item="chunk_id")
    return lexical.bm25_stored(queries(spark, sf_dir), path)


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a text file of its own, below a line with its id, and read back whole, one row a file."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").select(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("value"))
    body = F.expr("substring(text, instr(text, '\n') + 1)")
    result, schema = scratch(spark, "texts-read"), "doc_id long, text_md5 string, n_chars int"
    spark.createDataFrame([], schema).write.parquet(result)
    for found in files.read_rounds(spark, files.write_texts(docs, scratch(spark, "texts"))):
        rows = found.where("length > 0").select(F.substring_index("text", "\n", 1).cast("long").alias("doc_id"), F.md5(body).alias("text_md5"), F.length(body).alias("n_chars"))
        rows.write.mode("append").parquet(result)
    return spark.read.schema(schema).parquet(result)


S1 = "SELECT doc_id, md5(coalesce(text, '') || chr(10)) AS text_md5, CAST(length(coalesce(text, '')) + 1 AS INTEGER) AS n_chars FROM documents"


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of uploads."""
    d = spark.readStream.schema(STREAM).parquet(f"{sf_dir}/document*.parquet")
    return d.select(F.col("source").alias("tenant_id"), "doc_id", "text", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("at"))


#: Remainders of doc_id by 3, in the order in which documents are uploaded.
ARRIVAL = (2, 0, 1)


def _arrived(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Uploads in three batches, each followed by a run of the intake job from its checkpoint."""
    path = scratch(spark, name)
    d = documents(spark, sf_dir).select("tenant_id", "doc_id", "text")
    for rest in ARRIVAL:
        d.where(F.col("doc_id") % 3 == rest).write.mode("append").parquet(f"{path}/uploads")
        stream = spark.readStream.schema(d.schema).parquet(f"{path}/uploads")
        jobs.intake_job(stream, path, f"{path}/checkpoint", cleaning.Rules()).trigger(availableNow=True).start().awaitTermination()
    return path


def st1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the incremental intake keeps of all uploads."""
    path = _arrived(spark, sf_dir, "intake")
    return spark.read.parquet(f"{path}/chunks").groupBy("tenant_id", "doc_id").agg(F.count(F.lit(1)).alias("n_chunks")).select("tenant_id", "doc_id")


_FIRST = f"SELECT source AS tenant_id, sha256(text) AS hash, arg_min(doc_id, list_position({list(ARRIVAL)}, doc_id % 3)::BIGINT * 1000000000 + doc_id) AS doc_id, any_value(text) AS text FROM documents GROUP BY 1, 2"
ST1 = rf"SELECT tenant_id, doc_id FROM ({_FIRST}) WHERE regexp_matches(text, '\S')"


def d3_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first writer of each hash over all batches, and the batch it came with."""
    path = _arrived(spark, sf_dir, "first-writer")
    return spark.read.parquet(f"{path}/hashes").select("tenant_id", "hash", "document_id", F.col("batch").cast("int").alias("batch"))


D3_STREAM = f"SELECT tenant_id, hash, doc_id AS document_id, CAST(list_position({list(ARRIVAL)}, doc_id % 3) - 1 AS INTEGER) AS batch FROM ({_FIRST})"


def _written(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    path = scratch(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def st2(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _uploads(spark, sf_dir).withColumn("hash", intake.fingerprint(F.col("text"))).select("tenant_id", "hash", "at")
    return _written(jobs.distinct_uploads(hashed, "3650 days"), spark, "distinct").select("tenant_id", "hash")


ST2 = "SELECT DISTINCT source AS tenant_id, sha256(text) AS hash FROM documents"


def st3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed days with more than one request of a client."""
    return _written(jobs.quota_counts(_requests(spark, sf_dir, 20), 1, "1 day"), spark, "quota").select("client", "endpoint", "start", "n")


ST3 = """WITH r AS (SELECT user_id % 20 AS client, event_type AS endpoint, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY ALL)
SELECT client, endpoint, start, n FROM r WHERE n > 1 AND start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE"""


def _requests(spark: SparkSession, sf_dir: str, clients: int) -> DataFrame:
    """Events as a stream of requests; client 0 is an administrator."""
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event*.parquet")
    client = F.col("user_id") % clients
    return e.select(client.alias("client"), F.when(client == 0, "admin").otherwise("user").alias("role"), F.col("event_type").alias("endpoint"), F.col("ts").cast("timestamp").alias("at"))


def st3_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed days over the quotas of N6, by role and endpoint."""
    counts = jobs.quota_counts(_requests(spark, sf_dir, 8), catalog.quotas(spark, sf_dir), "1 day")
    return _written(counts, spark, "quota-limits")


ST3_LIMITS = f"SELECT * FROM ({catalog.N6}) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE"

QUERIES = {"s1_text_files": s1, "r1_bm25_stored": r1_stored, "s5_document_sink": s5, "s8_result_export": s8, "s3_evaluation_file": s3_file, "st1_intake_stream": st1, "st2_distinct_stream": st2, "st3_quota_stream": st3, "st3_quota_limits": st3_limits, "d3_first_writer_stream": d3_stream}
ORACLE_SQL = {"s1_text_files": S1, "r1_bm25_stored": retrieval.R1, "s5_document_sink": S5, "s8_result_export": S8, "s3_evaluation_file": S3_FILE, "st1_intake_stream": ST1, "st2_distinct_stream": ST2, "st3_quota_stream": ST3, "st3_quota_limits": ST3_LIMITS, "d3_first_writer_stream": D3_STREAM}
