"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch, shared_dir

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that survive a lost executor, and gives later joins a measured size. The folders are named
    by application, so that :func:`clear_staged` (or the cluster's retention rule) can drop them once results are written.
    """
    path = scratch(df.sparkSession, name)
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table up to which it is broadcast.
SMALL_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """A staged table of few plain columns, to be broadcast if its values are counted to take at most SMALL_BYTES, else to be merged by shuffle."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 8 if t == "string" else F.lit(16) for c, t in df.dtypes), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= SMALL_BYTES else df.hint("merge")


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders of the tables that are staged inside the block, in order; for :func:`drop` once nothing reads them."""
    made: list[str] = []
    before = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(before)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables; what still reads them fails."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> None:
    """Delete this application's staged tables; results that were not written yet become unreadable."""
    drop(spark, f"{shared_dir(spark)}/docweave-{spark.sparkContext.applicationId}")


def unpacked(df: DataFrame, *new: str) -> DataFrame:
    """The fields of the ``row`` struct and the ``new`` columns, which replace fields of the same name."""
    taken = {n.lower() for n in new}
    return df.select(*[F.col("row").getField(n).alias(n) for n in df.schema["row"].dataType.names if n.lower() not in taken], *new)


#: Bits of one bitmap of Spark's bitmap functions, and the most bitmaps (4 KB each) that a pre-filter broadcasts.
BITMAP_BITS, MOST_BITMAPS = 32768, 4096


def _flagged(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` with _may: whether ``key`` can be a value of the one-column table ``wanted``; false is certain.

    A membership bitmap of ``wanted`` is broadcast; it has 16 bits for each value up to MOST_BITMAPS * 4 KB = 16 MB, its proven
    bound. Values can share a bit; beyond the bound more do, and more rows say true.
    """
    (column,) = wanted.columns
    n = min(MOST_BITMAPS, max(1, -(-wanted.count() * 16 // BITMAP_BITS)))

    def place(c: Column) -> tuple[Column, Column]:
        h = F.xxhash64(c, F.lit("bitmap"))
        return F.pmod(h, F.lit(n)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(BITMAP_BITS)).cast("int")

    part, bit = place(F.col(column))
    maps = wanted.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(bit.cast("long")).alias("_map"))
    part, bit = place(key)
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumns({"_part": part, "_bit": bit}).join(F.broadcast(maps), "_part", "left")
    may = F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(1) == 1
    return found.withColumn("_may", F.coalesce(may, F.lit(False)))


def prefilter(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Drop most rows whose ``key`` is not in the one-column table ``wanted`` (of the same type), before a join that would shuffle them; the
    join must still follow."""
    return _flagged(rows, F.col(key), wanted).where("_may").select(*rows.columns)


def without(docs: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (named as the columns of ``gone``, of the same types) are not in ``gone``; rows with a null key stay.

    The first key decides by a bitmap which rows may have to go: only these are shuffled, for the exact join. All others pass where
    they are read.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    (first, key), names = next(iter(keys.items())), list(keys)
    stay = _flagged(docs.select(row, key.alias(first)), F.col(first), gone.select(first)).where("not _may").select("row.*")
    may = _flagged(docs.select(row, *[c.alias(n) for n, c in keys.items()]), F.col(first), gone.select(first)).where("_may")
    return stay.unionAll(may.join(gone.select(*names).hint("merge"), names, "left_anti").select("row.*"))
