"""Text files, evaluation sets, rule files, and the sinks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cleaning import Rules, merge_rules

#: Files of one folder, and of one task and one round of reading, at most.
IN_FOLDER, IN_TASK, IN_ROUND = 1_000, 2_000, 100_000

RULES_SCHEMA = (
    "name string, enabled boolean, formArtifacts array<string>, headerFooterPatterns array<string>, formFieldPatterns array<string>, signaturePatterns array<string>, dateFieldPatterns array<string>, "
    "wordSpacing struct<enabled: boolean, pattern: string>, repetitiveContent struct<enabled: boolean, threshold: int, minimumLineLength: int>, "
    "strategies struct<tableFormatting: struct<enabled: boolean, convertSeparators: boolean, separatorReplacement: string>, repetitiveContent: struct<enabled: boolean, threshold: int, minimumLineLength: int>>"
)


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_path, file_name, length, text): one row per UTF-8 file, with its bytes as they are. (The text source does the same, but sets up a
    Hadoop configuration for each file, which takes four times as long as reading it.)"""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("_metadata.file_path", "_metadata.file_name", F.col("_metadata.file_size").alias("length"), F.col("content").cast("string").alias("text"))


def read_rounds(spark: SparkSession, folders: list[tuple[str, int]]) -> Iterator[DataFrame]:
    """:func:`read_texts` of folders (path, files) by rounds, one after another: the driver holds the names of one round's files. A file index packs few
    small files into a task; a round has about as many tasks as keep all cores busy."""
    start = n = 0
    for i, (_, files) in enumerate(folders):
        n += files
        if i + 1 == len(folders) or n + folders[i + 1][1] > IN_ROUND:
            yield read_texts(spark, *[path for path, _ in folders[start : i + 1]]).coalesce(max(2 * spark.sparkContext.defaultParallelism, n // IN_TASK))
            start, n = i + 1, 0


def write_texts(texts: DataFrame, path: str) -> list[tuple[str, int]]:
    """Every row of ``texts`` (value) as a file of its own, ended by a line feed, in folders below ``path``: the folders (path, files at most).

    Spark's writer has four processes started for each file that goes to a mounted folder (modes of the file and its checksum, without native Hadoop),
    and moves all files once more on the driver. There the tasks write themselves, each attempt to folders of its own: those of attempts that
    fail are not returned.
    """
    spark = texts.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        return [tuple(r) for r in texts.select(F.coalesce("value", F.lit("")).alias("value")).mapInArrow(file_writer(root.toUri().getPath()), "folder string, files int").collect()]
    numbered = texts.select("value", F.floor(F.monotonically_increasing_id() / IN_FOLDER).alias("folder"))
    numbered.write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
    return [(f.getPath().toString(), IN_FOLDER) for f in fs.listStatus(root) if f.isDirectory()]


def file_writer(root: str):
    """A step that writes each value of its rows to a file, and gives the folders and how many files each got."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = f"{root}/part-{TaskContext.get().partitionId():05}-{TaskContext.get().taskAttemptId()}", 0
        for batch in batches:
            for value in batch["value"].cast(pa.large_binary()):
                folder = f"{own}/{n // IN_FOLDER:05}"
                if n % IN_FOLDER == 0:
                    os.makedirs(folder)
                with open(f"{folder}/{n % IN_FOLDER:05}.txt", "wb") as f:
                    f.write(value.as_buffer())
                    f.write(b"\n")
                n += 1
        counts = [IN_FOLDER] * (n // IN_FOLDER) + [n % IN_FOLDER] * (n % IN_FOLDER > 0)
        yield pa.RecordBatch.from_arrays([pa.array([f"{own}/{i:05}" for i in range(len(counts))], pa.string()), pa.array(counts, pa.int32())], ["folder", "files"])

    return step


def read_evaluation_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, qrels) of JSON files {documents: [...], queries: [{id, text, relevantDocIds, queryType}]}."""
    schema = "documents array<struct<id: string, text: string, source: string>>, queries array<struct<id: string, text: string, relevantDocIds: array<string>, queryType: string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    docs = raw.select(F.explode("documents").alias("d")).select(F.col("d.id").alias("item_id"), "d.text", "d.source")
    qs = raw.select(F.explode("queries").alias("q"))
    queries = qs.select(F.col("q.id").alias("query_id"), "q.text", F.col("q.queryType").alias("query_type"))
    qrels = qs.select(F.col("q.id").alias("query_id"), F.explode("q.relevantDocIds").alias("item_id"))
    return docs, queries, qrels


def read_rules(spark: SparkSession, directory: str, active: list[str]) -> Rules:
    """The rule files of ``active`` (in order; missing and disabled ones are skipped), merged. The one merged row reaches the driver."""
    raw = spark.read.schema(RULES_SCHEMA).json(f"{directory.rstrip('/')}/*.json", multiLine=True).withColumn("_file", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1))
    order = F.array(*map(F.lit, active))
    sets = raw.withColumn("position", F.array_position(order, F.col("_file"))).where("position > 0").withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    config = F.coalesce("repetitiveContent", F.col("strategies.repetitiveContent"))
    sets = sets.select("position", "enabled", F.col("formArtifacts").alias("artifacts"), F.col("formFieldPatterns").alias("fields"), F.col("signaturePatterns").alias("signatures"), F.col("dateFieldPatterns").alias("dates"), F.col("wordSpacing").alias("spacing"), config.alias("repeated"), F.col("strategies.tableFormatting").alias("table_"))
    row = merge_rules(sets).first()
    if not row["n_sets"]:
        raise ValueError("no active rule set was found")
    spacing, repeated, table = row["spacing"], row["repeated"], row["table_"]
    return Rules(
        row["artifacts"], row["fields"], row["signatures"], row["dates"], spacing["pattern"] if spacing and spacing["enabled"] else None, bool(spacing and spacing["enabled"]),
        (table["separatorReplacement"] or ", ") if table and table["enabled"] and table["convertSeparators"] else None,
        (repeated["threshold"], repeated["minimumLineLength"]) if repeated and repeated["enabled"] else None,
    )


def write_documents(docs: DataFrame, chunks: DataFrame, path: str) -> None:
    """Documents and chunks as Parquet by tenant; only the tenants that are written are replaced."""
    for name, df in (("documents", docs), ("chunks", chunks)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(f"{path}/{name}")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors by tenant, with their payload; only the tenants that are written are replaced."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(path)


def stamped(base: str, extension: str, at: datetime) -> str:
    """``base`` with the time of an export in its name."""
    return f"{base}_{at:%Y-%m-%d_%H-%M-%S}{extension}"


def write_results(rolled: DataFrame, path: str, metrics: list[str], at: datetime | None = None) -> tuple[str, str]:
    """The roll-up as CSV (metrics with four decimals, latencies with two) and as JSON with nested metrics, in folders below ``path`` that carry the
    time ``at`` in their names, if it is given; their paths."""
    names = tuple(f"{path}/{stamped('results', f'.{kind}', at) if at else kind}" for kind in ("csv", "json"))
    flat = rolled.select("strategy", "query_type", *[F.format_string("%.4f", F.col(m)).alias(m) for m in metrics], *[F.format_string("%.2f", F.col(m).cast("double")).alias(m) for m in ("p50_ms", "p95_ms", "p99_ms")], "n")
    flat.write.mode("overwrite").option("header", True).csv(names[0])
    nest = lambda x: F.struct(*[F.col(f"{x}_at_{k}").alias(f"At{k}") for k in (5, 10)])
    nested = rolled.select("strategy", "query_type", nest("p").alias("precision"), nest("r").alias("recall"), F.col("rr").alias("mrr"), F.struct("p50_ms", "p95_ms", "p99_ms").alias("latency"), "n")
    nested.write.mode("overwrite").json(names[1])
    return names
