"""Small Column helpers shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: White space of every kind, as an explicit class: Java's plain \s is ASCII only.
SPACE = r"[\s\u0085   -     　]"

#: The same characters one by one.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(SPACE.replace(r"\s", " \t\n\x0b\f\r"), c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas inside ``body`` use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_all(c: Column) -> Column:
    """Strip white space of every kind from both ends (``trim`` takes spaces only)."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"[^\s\u0085   -     　]")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, a plain scan, dealt by ``key`` over all cores where its parts would leave half of them or more idle, as a small file of one row
    group does. It pays before costly expressions; a table of more parts is left as it is, so that large ones are never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * df.rdd.getNumPartitions() <= cores else df


def errors(*checks: tuple[Column, str | Column]) -> Column:
    """The messages of the checks that hold, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for bad, m in checks]))


#: Bytes of a table up to which it is broadcast.
MOST_BYTES = 8 << 20


def within(df: DataFrame, most: int = MOST_BYTES) -> tuple[Callable[[DataFrame], DataFrame], bool]:
    """How tables of no more rows than ``df``, and no wider ones, are to be joined: broadcast if the values of ``df`` are counted to take at most
    ``most`` bytes, merged by shuffle otherwise; and whether they are few. ``df`` must be cheap to count."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t in ("string", "binary") else F.lit(16) if "<" not in t else F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c, t in df.dtypes), F.lit(0))
    few = (df.agg(F.sum(width)).first()[0] or 0) <= most
    return (F.broadcast if few else lambda x: x.hint("merge")), few


def sized(df: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``df`` to be broadcast if its values are counted to take at most ``most`` bytes, to be merged by shuffle otherwise."""
    return within(df, most)[0](df)
