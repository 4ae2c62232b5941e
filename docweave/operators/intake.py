"""Intake checks and exact duplicates per tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.common import errors

MB = 1024 * 1024
#: File types that are accepted, of which only the last is read here.
EXTENSIONS = [".pdf", ".docx", ".txt"]


def check_files(files: DataFrame, name: str = "file_name", length: str = "length", most: int = 10 * MB) -> DataFrame:
    """``files`` with extension, errors and route: "accepted", "unsupported" (accepted by name, not readable here), "rejected"."""
    n = F.col(name)
    extension = F.lower(F.regexp_extract(n, r"(\.[^./\\]+)$", 1))
    allowed = F.array(*map(F.lit, EXTENSIONS))
    found = errors(
        (F.col(length) > most, f"File size exceeds maximum allowed size of {most // MB} MB"),
        (~F.array_contains(allowed, extension), F.concat(F.lit("File type '"), extension, F.lit(f"' is not allowed. Allowed types: {', '.join(EXTENSIONS)}"))),
        (F.contains(n, F.lit("..")) | F.contains(n, F.lit("/")) | F.contains(n, F.lit("\\")), "Invalid file name"),
    )
    out = files.withColumn("extension", extension).withColumn("errors", F.when(F.col(length) == 0, F.array(F.lit("File cannot be empty"))).otherwise(found))
    return out.withColumn("route", F.when(F.size("errors") > 0, "rejected").when(F.col("extension") == ".txt", "accepted").otherwise("unsupported"))


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def duplicates(uploads: DataFrame, history: DataFrame | None = None, key: str = "doc_id", tenant: str = "tenant_id", digest: str = "hash", arrival: str = "doc_id") -> DataFrame:
    """``uploads`` with status (Uploaded or AlreadyExists) and existing_id: the first arrival of a (tenant, hash) wins.

    ``history`` (tenant, hash, document_id) holds winners of earlier batches; one row for each (tenant, hash).
    """
    first = uploads.groupBy(tenant, digest).agg(F.min_by(F.col(key), F.struct(F.col(arrival), F.col(key))).alias("_first"))
    if history is not None:
        first = first.join(history.select(F.col(tenant), F.col(digest), F.col("document_id").alias("_known")).hint("merge"), [tenant, digest], "left").withColumn("_first", F.coalesce("_known", "_first")).drop("_known")
    out = uploads.join(first.hint("merge"), [tenant, digest])
    return out.withColumn("status", F.when(F.col("_first") == F.col(key), "Uploaded").otherwise("AlreadyExists")).withColumnRenamed("_first", "existing_id")


def new_hashes(uploads: DataFrame, history: DataFrame | None = None, **names: str) -> DataFrame:
    """The (tenant, hash, document_id) rows that a batch adds: losers of a race read the winner and add nothing."""
    tenant, digest, key = names.get("tenant", "tenant_id"), names.get("digest", "hash"), names.get("key", "doc_id")
    return duplicates(uploads, history, **names).where("status = 'Uploaded'").select(tenant, digest, F.col(key).alias("document_id"))


def check_requests(requests: DataFrame, most_length: int = 5000, most_k: int = 100, most_tokens: int = 4000) -> DataFrame:
    """``requests`` (query, top_k, threshold, alpha, beta, temperature, max_tokens) with errors and valid; null parameters are not checked."""
    c = F.col
    outside = lambda x, lo, hi: ~c(x).between(lo, hi)
    found = errors(
        (c("query").isNull() | (F.trim("query") == ""), "Query cannot be empty"),
        (F.length("query") > most_length, f"Query cannot exceed {most_length} characters"),
        (outside("top_k", 1, most_k), f"TopK must be between 1 and {most_k}"),
        (outside("threshold", 0, 1), "Threshold must be between 0.0 and 1.0"),
        (outside("alpha", 0, 1), "Alpha must be between 0.0 and 1.0"),
        (outside("beta", 0, 1), "Beta must be between 0.0 and 1.0"),
        (F.abs(c("alpha") + c("beta") - 1) > 0.001, "Alpha + Beta must equal 1.0"),
        (outside("temperature", 0, 1), "Temperature must be between 0.0 and 1.0"),
        (outside("max_tokens", 1, most_tokens), f"MaxTokens must be between 1 and {most_tokens}"),
    )
    return requests.withColumn("errors", found).withColumn("valid", F.size("errors") == 0)
