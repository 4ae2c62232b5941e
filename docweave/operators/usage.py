"""System statistics, audit search and quota analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.common import sized


def system_stats(docs: DataFrame, chunks: DataFrame, queries: DataFrame, updated: str = "updated_at") -> DataFrame:
    """One row: documents, chunks, queries, last update."""
    d = docs.agg(F.count(F.lit(1)).alias("documents"), F.max(updated).alias("last_update")).first()
    n_chunks, n_queries = (x.agg(F.count(F.lit(1))).first()[0] for x in (chunks, queries))
    spark = docs.sparkSession
    return spark.range(1).select(F.lit(d["documents"]).alias("documents"), F.lit(n_chunks).alias("chunks"), F.lit(n_queries).alias("queries"), F.lit(d["last_update"]).alias("last_update"))


def documents_per_tenant(docs: DataFrame) -> DataFrame:
    return docs.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("documents"))


def search_audit(log: DataFrame, user: int | None = None, action: str | None = None, resource: str | None = None, since: str | None = None, until: str | None = None, number: int = 1, size: int = 50, most: int = 100) -> DataFrame:
    """One page of the log (id, user_id, action, resource, at, ...), newest first, with the total. Bounds are inclusive."""
    rows = log
    for c, v in (("action", action), ("resource", resource)):
        rows = rows if v is None else rows.where(F.contains(F.col(c), F.lit(v)))
    rows = rows if user is None else rows.where(F.col("user_id") == user)
    rows = rows if since is None else rows.where(F.col("at") >= F.lit(since).cast("timestamp"))
    rows = rows if until is None else rows.where(F.col("at") <= F.lit(until).cast("timestamp"))
    size, total = min(size, most), rows.count()
    return rows.orderBy(F.desc("at"), F.desc("id")).offset((number - 1) * size).limit(size).withColumn("total", F.lit(total))


def shape_audit(rows: DataFrame, details: list[str]) -> DataFrame:
    """Audit rows with action and resource cut to their columns' widths, details as JSON, and the duration in ms of started_at and ended_at."""
    ms = F.unix_millis(F.col("ended_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return rows.withColumn("action", F.substring("action", 1, 100)).withColumn("resource", F.substring("resource", 1, 255)).withColumn("details", F.to_json(F.struct(*details))).withColumn("duration_ms", ms)


def over_quota(requests: DataFrame, limits: DataFrame, window: str = "1 minute") -> DataFrame:
    """(client, endpoint, start, n, quota) of fixed windows with more requests than the quota of (role, endpoint), where "*" stands
    for any endpoint; the strictest quota that fits counts. ``requests``: client, role, endpoint, at."""
    counts = requests.groupBy("client", "role", "endpoint", F.window("at", window)["start"].alias("start")).agg(F.count(F.lit(1)).alias("n"))
    lim = sized(limits.select("role", F.col("endpoint").alias("_e"), "quota"))
    rows = counts.join(lim, "role").where((F.col("_e") == "*") | (F.col("_e") == F.col("endpoint")))
    return rows.groupBy("client", "endpoint", "start", "n").agg(F.min("quota").alias("quota")).where("n > quota")
