"""Structured Streaming jobs: incremental intake, duplicate filter, quota counts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import chunking, cleaning, intake


#: The state store that keeps the winners of earlier batches on disk (Spark's own, over RocksDB).
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstWriter(StatefulProcessor):
    """Keeps, for each (tenant, hash), the id of the first upload ever; of one batch's uploads the one with the smallest id."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", f"doc_id {self.kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.first.exists():
            winner = min(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"]))
            self.first.update((winner["doc_id"],))
            yield winner

    def close(self) -> None:
        pass


def first_uploads(uploads: DataFrame) -> DataFrame:
    """The uploads (tenant_id, doc_id, text) that are the first ones of their (tenant, hash), with the hash. The state is keyed, so that a batch looks
    up its own hashes only, whatever came before; rows of one hash pass one after another, and are not gathered."""
    rows = uploads.select("tenant_id", "doc_id", "text", intake.fingerprint(F.col("text")).alias("hash"))
    return rows.groupBy("tenant_id", "hash").transformWithState(FirstWriter(rows.schema["doc_id"].dataType.simpleString()), rows.schema, "Append", "None")


def intake_job(uploads: DataFrame, path: str, checkpoint: str, rules: cleaning.Rules, size: int = 512, overlap: int = 128) -> DataStreamWriter:
    """A writer for a stream of (tenant_id, doc_id, text): the first upload of each (tenant, hash) is kept, cleaned, chunked and written to
    ``path``/documents, ``path``/hashes and ``path``/chunks. Earlier hashes are Spark's keyed state (see :func:`first_uploads`; the session's state
    store is set to RocksDB, which it needs).

    Each batch owns the folder batch=<id>, and state is versioned by batch, so that a batch that is run again replaces what it wrote.
    """
    uploads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def run(batch: DataFrame, number: int) -> None:
        folder = f"{path}/documents/batch={number}"
        batch.write.mode("overwrite").parquet(folder)  # the state is asked once
        fresh = batch.sparkSession.read.schema(batch.schema).parquet(folder)
        fresh.select("tenant_id", "hash", F.col("doc_id").alias("document_id")).write.mode("overwrite").parquet(f"{path}/hashes/batch={number}")
        cleaned, _ = cleaning.split_rejects(cleaning.clean(fresh, rules))
        chunks = chunking.chunk(cleaned.select("tenant_id", "doc_id", F.col("cleaned").alias("text")), size, overlap)
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")

    return first_uploads(uploads).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def distinct_uploads(uploads: DataFrame, delay: str = "1 hour", at: str = "at") -> DataFrame:
    """The first upload of each (tenant, hash) inside the watermark; state is bounded by ``delay``."""
    return uploads.withWatermark(at, delay).dropDuplicatesWithinWatermark(["tenant_id", "hash"])


def quota_counts(requests: DataFrame, limit: int | DataFrame, window: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """(client, endpoint, start, n[, quota]) of closed windows over the limit; rows later than ``delay`` are dropped (:func:`late_rows` counts them).

    ``limit``: one number, or a table (role, endpoint, quota), where endpoint * stands for all: then requests have a role, and the least quota that
    fits holds. The table is joined to the closed windows of each batch; windows that no quota fits are never over one.
    """
    role = [] if isinstance(limit, int) else ["role"]
    counts = requests.withWatermark("at", delay).groupBy(F.window("at", window), "client", *role, "endpoint").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select("client", *role, "endpoint", F.col("window.start").alias("start"), "n")
    if isinstance(limit, int):
        return rows.where(F.col("n") > limit)
    every = limit.where("endpoint = '*'").groupBy("role").agg(F.min("quota").alias("_every"))
    own = limit.where("endpoint <> '*'").groupBy("role", "endpoint").agg(F.min("quota").alias("_own"))
    rows = rows.join(every, "role", "left").join(own, ["role", "endpoint"], "left").withColumn("quota", F.least("_every", "_own"))
    return rows.where("n > quota").select("client", "endpoint", "start", "n", "quota")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's recent batches dropped because they came after their window was closed."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
