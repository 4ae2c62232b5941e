"""Tables that grow by segments: every write adds one segment to one or more tables, and counts once it is committed.

A path holds one folder for each table with ``segment=<n>`` below it, and a small table of commits. A row carries its key and may be a
tombstone (``deleted``); the row of a key in the highest segment is the one that holds. A writer that fails leaves no commit: readers do
not see what it wrote, and the next writer replaces it. A compacted segment is a table's base: readers take it and what follows.

Tables are compressed by zstd, and the shuffles of a write are removed with it. One writer at a time for each path; readers are never disturbed, until :func:`drop_old` removes what a base has replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import LongType, StructType

from ..functions.common import within
from ..session import written

_COMMITS = "segment bigint, base boolean, table string, schema string"
ROW_GROUP = 16 << 20
#: Makes Spark remove the shuffle files of a query when it ends, not when the driver's memory is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class State:
    """The committed segments: the last one, and for each table its schema and its segments from its last base on."""

    last: int
    schemas: dict[str, str]
    segments: dict[str, list[int]]


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def state(spark: SparkSession, path: str) -> State:
    """What is committed below ``path``; a row for each segment and table reaches the driver."""
    out = State(0, {}, {})
    if _exists(spark, f"{path}/commits"):
        for r in sorted(spark.read.schema(_COMMITS).parquet(f"{path}/commits").collect()):
            out.last = max(out.last, r["segment"])
            out.schemas[r["table"]] = r["schema"]
            out.segments[r["table"]] = [r["segment"]] if r["base"] else [*out.segments.get(r["table"], []), r["segment"]]
    return out


def _commit(spark: SparkSession, path: str, segment: int, base: bool, schemas: dict[str, str]) -> None:
    rows = [(segment, base, name, schema) for name, schema in schemas.items()]
    spark.createDataFrame(rows, _COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def append(path: str, tables: dict, spark: SparkSession, buckets: dict[str, str] | None = None, base: bool = False, number: int | None = None) -> int:
    """Write one segment of ``tables`` and commit it; the number of the segment (a new one, or ``number``).

    A table is a DataFrame, or a function of the tables that were written before (as they are read back), or a pair of these: then the second one
    is added to the rows of the first, and may read them. ``buckets``: by table, the column whose values get folders of their own.
    """
    number, done, schemas = number or state(spark, path).last + 1, {}, {}
    for name, parts in tables.items():
        folder = f"{path}/{name}/segment={number}"
        for i, df in enumerate(parts if isinstance(parts, tuple) else (parts,)):
            df = df(done) if callable(df) else df
            out = df.write.mode("append" if i else "overwrite").option("compression", "zstd")
            with cleaned(spark):
                # Rows of tables with buckets are long: a reader decodes a row group at once.
                (out.partitionBy(buckets[name]).option("parquet.block.size", ROW_GROUP) if buckets and name in buckets else out).parquet(folder)
            if not i:
                schemas[name] = df.schema
                done[name] = spark.read.schema(df.schema).parquet(folder)
    _commit(spark, path, number, base, {name: schema.json() for name, schema in schemas.items()})
    return number


def rows(spark: SparkSession, path: str, name: str, at: State | None = None) -> DataFrame | None:
    """All committed rows of a table since the last base, with their ``segment``; None if the table was never written."""
    at = at or state(spark, path)
    if name not in at.schemas:
        return None
    schema = StructType.fromJson(json.loads(at.schemas[name])).add("segment", LongType())
    folders = [f"{path}/{name}/segment={n}" for n in at.segments[name]]
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*folders)


def newest(found: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the highest segment, unless it is a tombstone; a key is written at most once in a segment."""
    order = W.partitionBy(*keys).orderBy(F.desc("segment"))
    return found.withColumn("_rn", F.row_number().over(order)).where("_rn = 1 and not deleted").drop("_rn", "deleted")


def settled(found: DataFrame, *keys: str) -> DataFrame:
    """:func:`newest` for whole rows: those of keys with one row stay where they are, if the hashes of the other keys are few; the others are shuffled."""
    key = F.xxhash64(*keys)
    several = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("deleted").alias("deleted")).where("n > 1 or deleted").select(key.alias("_key")).distinct()
    several = written(several, "outdated")
    few, bounded = within(several)
    if not bounded:
        return newest(found, *keys)
    hashed = found.withColumn("_key", key)
    alone = hashed.join(few(several), "_key", "left_anti").drop("_key", "deleted")
    return alone.unionByName(newest(hashed.join(few(several), "_key", "left_semi").drop("_key"), *keys))


def drop_old(spark: SparkSession, path: str) -> None:
    """Remove the folders of tables' segments before their last base."""
    at = state(spark, path)
    for r in spark.read.schema(_COMMITS).parquet(f"{path}/commits").select("table", "segment").distinct().collect() if at.last else []:
        if r["segment"] < at.segments[r["table"]][0]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{r['table']}/segment={r['segment']}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
