"""Re-indexing: run the pipeline again for one tenant or all, over the stored catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from . import cleaning, store


def reindex(spark: SparkSession, docs: DataFrame, path: str, rules: cleaning.Rules, tenant: str | None = None, embedded: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Clean, chunk, index and (with ``embedded``: chunks to :func:`store.vector_rows`) embed the tenant's documents (all without ``tenant``),
    replacing what the store at ``path`` holds of them; returns one run row: tenant_id, estimated, processed, status, started_at, completed_at.

    Everything is one segment, which is seen when it is complete: a run that fails raises, and the old rows stay. The counts are
    observed while the documents are written. Documents without text leave the store.
    """
    rows = docs if tenant is None else docs.where(F.col("tenant_id") == tenant)
    started = spark.range(1).select(F.current_timestamp()).first()[0]
    n = F.count(F.lit(1)).alias("n")
    seen, kept = Observation("estimated"), Observation("processed")
    accepted, _ = cleaning.split_rejects(cleaning.clean(rows.observe(seen, n), rules))
    accepted = accepted.select(*[c if c != "text" else F.col("cleaned").alias("text") for c in docs.columns]).observe(kept, n)
    store.put_documents(spark, path, accepted, within=(lambda old: old) if tenant is None else (lambda old: old.where(F.col("tenant_id") == tenant)), embedded=embedded)
    return spark.range(1).select(
        F.lit(tenant).alias("tenant_id"), F.lit(int(seen.get["n"])).alias("estimated"), F.lit(int(kept.get["n"])).alias("processed"), F.lit("Completed").alias("status"),
        F.lit(started).alias("started_at"), F.current_timestamp().alias("completed_at"),
    )
