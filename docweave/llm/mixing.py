"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Every document expects rate = target / source size copies. Expected copies are prefix-summed within the source, one random
offset per source is added, and a document is emitted once for each integer boundary that its interval crosses. Documents
are taken in order of size classes, so that a source's taken words come close to its target.

The prefix sum is two-level, so that no task holds a source: blocks (source, size class, hash range) are summed first, a
window over the few block rows gives each block's start, and a window inside each block does the rest. Expected copies are
whole multiples of 2**-24, hence sums are exact and reruns agree.

Defined cases: null text has size 0 (it may be emitted, taking 0 words); a null source is a source of its own, last in
order; equal sizes are ordered by hash and doc_id, rows of one doc_id by size and a hash of the text, so that reruns agree; repeated
rows are separate documents; an empty table gives an empty result; extra columns are kept by :func:`mix_rows`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .staging import staged

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1 << 24


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def spread(value: Column, seed: str) -> Column:
    """A hash of 32 bits that SQL engines share (the head of an MD5 sum)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(value.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Grows with the size: four classes for each doubling."""
    bits = F.length(F.bin(size)).cast("int")
    return bits * 8 + F.call_function("shiftright", size * 8, bits).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Targets of (src, source, source_size): ``share`` of all sizes dealt by weight, none above ``cap`` times its source.

    Dealing the excess again until nothing is above its cap ends where target = min(cap * size, level * weight); sources reach
    their caps in order of size / weight, so that running sums decide each. One row per source passes these windows.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(W.partitionBy()) * share)
    up = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    x = x.withColumn("before", F.coalesce(F.sum("source_size").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * cap)
    x = x.withColumn("open", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("full", (F.col("total") - F.col("before")) * F.col("weight") >= F.col("source_size") * cap * F.col("open"))
    everywhere = W.partitionBy()
    left = F.col("total") - cap * F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(everywhere), F.lit(0))
    among = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everywhere)
    return x.select("src", "source_size", F.when(F.col("full"), F.col("source_size") * cap).otherwise(F.col("weight") * left / among).alias("target"))


def with_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the ``keep`` columns of ``docs``, all by default), ``size``, ``source_size``, ``target``, ``copies``. What is kept is shuffled once."""
    keep = docs.columns if keep is None else keep
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    rows = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("row"), F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"),
        key.alias("src"), n_words(F.col(text)).alias("size"), spread(F.col(doc_id), seed).alias("h"), F.xxhash64(text).alias("tie"),
    )
    n = rows.select("src").count()
    parts = max(1, math.ceil(math.sqrt(n) / 16))
    rows = rows.withColumn("class", size_class(F.col("size"))).withColumn("part", F.floor(F.col("h") * parts / F.lit(1 << 32)).cast("int"))
    blocks = staged(rows.groupBy("src", "class", "part").agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")), "blocks")
    sizes = blocks.groupBy("src").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    goals = source_targets(sizes, weights, share, cap)
    goals = goals.withColumn("each", F.least(F.lit(int(cap * UNIT)), F.coalesce(F.round(F.try_divide(F.col("target"), F.col("source_size")) * UNIT), F.lit(0.0)).cast("long")))
    starts = W.partitionBy("src").orderBy("class", "part").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.drop("source").join(goals.hint("shuffle_hash"), "src")
    blocks = blocks.withColumn("start", F.coalesce(F.sum(F.col("docs") * F.col("each")).over(starts), F.lit(0)) + spread(F.col("src"), seed) % UNIT)
    rows = rows.join(blocks.select("src", "class", "part", "start", "each", "source_size", "target").hint("merge"), ["src", "class", "part"])
    inside = W.partitionBy("src", "class", "part").orderBy("h", "id", "size", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.col("start") + F.sum("each").over(inside)
    rows = rows.withColumn("end", end)
    copies = F.floor(F.col("end") / UNIT) - F.floor((F.col("end") - F.col("each")) / UNIT)
    return rows.select("row", "size", "source_size", F.round("target", 6).alias("target"), copies.cast("long").alias("copies"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix: each row of ``docs`` as often as it is drawn."""
    rows = with_copies(docs, **options).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
