"""Sliding-window chunks, their metadata and checks, and the embedding stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import errors, is_blank, let

RATIO = 1.3  # tokens for a word
STRATEGY = "SlidingWindow"


def chunk(docs: DataFrame, size: int = 512, overlap: int = 128, key: str = "doc_id", tenant: str = "tenant_id", text: str = "text") -> DataFrame:
    """One row per chunk: tenant, key, chunk_index, chunk_id, text, start_index, end_index, word_count, token_count, strategy.

    Sizes are in tokens. Chunk texts are raw slices. Everything stays in the row until the explode, so that no shuffle is needed;
    offsets come from the lengths of whole steps, so that long texts are not summed again for every chunk.
    """
    window, lap = int(size / RATIO), int(overlap / RATIO)
    step = window - lap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    text_ = F.col(text)
    words = F.regexp_extract_all(text_, F.lit("[^ \t\r\n]+[ \t\r\n]*"), F.lit(0))

    def slices(ws: Column) -> Column:
        n, lead = F.size(ws), F.length(F.regexp_extract(text_, "^[ \t\r\n]*", 0))
        row = lambda i, body, start, n: F.struct(i.cast("int").alias("chunk_index"), body.alias("text"), start.cast("int").alias("start_index"), n.cast("int").alias("word_count"))
        steps = F.transform(F.sequence(F.lit(0), n - lap - 1, F.lit(step)), lambda s: F.array_join(F.slice(ws, s + 1, F.lit(step)), ""))
        lengths = F.transform(steps, F.length)

        def parts(ls: Column) -> Column:
            start = lambda i: lead + F.aggregate(F.slice(ls, F.lit(1), i), F.lit(0), lambda a, x: a + x)
            return F.transform(F.sequence(F.lit(0), n - lap - 1, F.lit(step)), lambda s, i: row(i, F.array_join(F.slice(ws, s + 1, F.lit(window)), ""), start(i), F.least(F.lit(window), n - s)))

        return F.when(n <= window, F.array(row(F.lit(0), text_, F.lit(0), n))).otherwise(let(lengths, parts))

    rows = docs.where(text_.isNotNull() & (text_ != "")).select(tenant, key, F.explode(let(words, slices)).alias("c"))
    return rows.select(
        tenant, key, "c.chunk_index", F.sha2(F.concat_ws("|", F.col(tenant).cast("string"), F.col(key).cast("string"), F.col("c.chunk_index").cast("string")), 256).alias("chunk_id"),
        "c.text", "c.start_index", (F.col("c.start_index") + F.length("c.text")).alias("end_index"), "c.word_count", F.floor(F.col("c.word_count") * RATIO).cast("int").alias("token_count"), F.lit(STRATEGY).alias("strategy"),
    )


def chunk_errors(chunks: DataFrame) -> DataFrame:
    """Chunks that break a rule, with the rules they break."""
    bad = errors((is_blank(F.col("text")), "text is empty"), (F.col("chunk_id").isNull(), "id is missing"), (F.col("start_index") < 0, "start is negative"), (F.col("end_index") <= F.col("start_index"), "end is not after start"))
    return chunks.withColumn("errors", bad).where(F.size("errors") > 0)


def document_metadata(docs: DataFrame, chunks: DataFrame, key: str = "doc_id", name: str = "file_name", text: str = "text") -> DataFrame:
    """File extension, character count, chunk count and chunk ids in order, for every document (also those without chunks)."""
    listed = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("ids"))
    out = docs.select(key, F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), F.length(text).alias("chars")).join(listed.hint("merge"), key, "left")
    return out.select(key, "extension", "chars", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce(F.transform("ids", lambda x: x["chunk_id"]), F.array().cast("array<string>")).alias("chunk_ids"))


def embed(chunks: DataFrame, vectorise: Callable[[list[str]], list], dimension: int, batch: int = 32, text: str = "text") -> DataFrame:
    """``chunks`` with an embedding column from the user's ``vectorise`` (texts to vectors), called for ``batch`` texts at a time.

    Blank texts, wrong counts and wrong dimensions raise an error in the task.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = []
            for i in range(0, len(s), batch):
                texts = s.iloc[i : i + batch].tolist()
                if any(t is None or not t.strip() for t in texts):
                    raise ValueError("a blank text cannot be embedded")
                got = list(vectorise(texts))
                if len(got) != len(texts) or any(len(v) != dimension for v in got):
                    raise ValueError(f"{len(texts)} vectors of {dimension} numbers were expected")
                out += got
            yield pd.Series(out)

    return chunks.withColumn("embedding", F.pandas_udf(run, "array<float>")(text))
