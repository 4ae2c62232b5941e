"""Exact de-duplication with a heavy-hitter split.

A Misra-Gries summary of each partition finds digests that may be frequent; summaries add up (they are mergeable), the
``counters`` largest become candidates, and one exact pass verifies them. The verified winners, at most ``counters`` rows by
construction, are broadcast: copies of frequent texts are decided where they are read. All other digests, each rarer than
about rows / counters, go through an ordinary shuffle.

Defined cases: null text counts as the empty text; texts are equal when equal after lower-casing A-Z; of equal texts the largest
``doc_id`` stays (a null id only when all ids are null); a row repeated with its ``doc_id`` counts in ``group_size`` and stays
with its twin, as ids name documents; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .staging import staged, without
from .words import tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTERS = 1024


def digest(text: str = "text") -> F.Column:
    return F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), 256)


def misra_gries(keys: dict[str, int], batch: pa.Array, counters: int) -> dict[str, int]:
    """Add a batch to a summary: exact counts are merged, then all are lowered by the first count beyond ``counters``."""
    for x in pc.value_counts(batch).to_pylist():
        keys[x["values"]] = keys.get(x["values"], 0) + x["counts"]
    if len(keys) <= counters:
        return keys
    least = int(np.partition(np.fromiter(keys.values(), np.int64, len(keys)), len(keys) - counters - 1)[len(keys) - counters - 1])
    return {k: n - least for k, n in keys.items() if n > least}


def frequent(digests: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` values of ``column``; every value with more than rows / (counters + 1) copies is among them."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, int] = {}
        for b in batches:
            keys = misra_gries(keys, b.column(0), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.string()), pa.array(list(keys.values()), pa.int64())], ["digest", "n"])

    parts = digests.select(column).mapInArrow(tidy(summary), "digest string, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep_id, group_size) of candidates that an exact count confirms as repeated; at most ``counters`` rows."""
    found = digests.join(F.broadcast(frequent(digests, "digest", counters)), "digest")
    out = found.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return staged(out, "winners")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = staged(docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("digest")), "digests")
    heavy = winners(digests, counters)
    group = W.partitionBy("digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    rest = rest.select("doc_id", "digest", F.max("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"))
    both = digests.join(F.broadcast(heavy), "digest").select("doc_id", "digest", "keep_id", "group_size").unionAll(rest)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only copies, and few rows that may be some, are shuffled with their texts."""
    name = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("n"))
    gone = exact_groups(docs, text, doc_id, counters).where("not kept").select(name("doc_id").alias("id"), F.col("text_sha256").alias("digest")).distinct()
    return without(docs, staged(gone, "gone"), id=name(doc_id), digest=digest(text))
