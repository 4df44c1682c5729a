"""Joins that no hot key can hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, facts: DataFrame, key: str, counts: DataFrame | None = None, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` (a written table, read twice) to ``facts``, which has one row per key.

    A key held by more than 1 / share of the rows (and more than 1,000 rows) is hot; there are fewer than ``share`` of
    them, so their facts are broadcast and no hot key meets in one task. The rest joins by shuffle. Null keys find nothing.
    ``counts`` (key, n) may give the rows per key where the caller has them.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot_keys = counts.where((F.col("n") > max(1000, rows.count() // share)) & F.col(key).isNotNull()).select(key)
    values = [c for c in facts.columns if c != key]
    hot = facts.join(F.broadcast(hot_keys), key, "left_semi").select(key, F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    found = F.col("_hot").isNotNull() | F.col(key).isNull()
    settled = marked.where(found).select(*rows.columns, *[F.col(f"_hot.{c}") for c in values])
    rest = marked.where(~found).select(*rows.columns).join(facts, key, "left").select(*rows.columns, *values)
    return settled.unionByName(rest)
