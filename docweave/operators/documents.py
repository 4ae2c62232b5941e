"""Document catalogue: listing and look-up. Stored tables, with cascading delete, are in ``store``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.common import sized
from ..functions.text import excerpt


def page(docs: DataFrame, tenant: str, number: int = 1, size: int = 20, title: str | None = None, key: str = "doc_id", title_column: str = "title") -> DataFrame:
    """One page of a tenant's documents, newest id first, with the total and page facts on every row."""
    rows = docs.where(F.col("tenant_id") == tenant)
    if title:
        rows = rows.where(F.contains(F.col(title_column), F.lit(title)))
    total = rows.count()
    pages = -(-total // size)
    out = rows.orderBy(F.desc(key)).offset((number - 1) * size).limit(size)
    return out.withColumns({"total": F.lit(total), "pages": F.lit(pages), "has_next": F.lit(number < pages), "has_previous": F.lit(number > 1)})


def look_up(docs: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of (tenant_id, key) pairs; pairs of another tenant find nothing."""
    return docs.join(sized(wanted.select("tenant_id", key).distinct()), ["tenant_id", key], "left_semi")


def list_chunks(chunks: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(tenant_id, key, chunk_index, preview) of the wanted documents' chunks."""
    rows = chunks.join(sized(wanted.select("tenant_id", key).distinct()), ["tenant_id", key], "left_semi")
    return rows.select("tenant_id", key, "chunk_index", excerpt(F.col("text")).alias("preview"))


def latest(rows: DataFrame, *keys: str, by: str) -> DataFrame:
    """The last row of each key."""
    order = W.partitionBy(*keys).orderBy(F.desc(by))
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
