"""A corpus preparation pipeline over ``documents``: language, exact copies, near copies, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is written as Parquet
and read again for the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import exact_dedup, language, mixing, near_dedup, sentencepieces
from docweave.llm.staging import collected, drop, staged


#: Rows of a batch that goes to a Python worker: whole texts take kilobytes each, and a batch is held by the executor and by the worker.
BATCH = "1000"


def short_batches(spark: SparkSession) -> None:
    """Set the session's batch size to BATCH rows, for stages that pass whole texts to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (no letters, or too uncertain) go."""
    short_batches(spark)
    model = language.learn(docs, "text", "lang", "doc_id")
    return language.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    short_batches(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 over five-word shingles, the smallest doc_id stays."""
    short_batches(spark)
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights draw them."""
    return mixing.mix_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    short_batches(spark)
    return sentencepieces.encode(docs, sentencepieces.load(), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: The classifier, the similarity join and the encoder have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's table, and what it staged itself, is deleted when the next one's is written."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with collected() as made:
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(spark, *old, *made[:-1])
        old = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
