"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. The
documents of a source stand in a fixed order (size class, then a digest of id and text); the expected
copies are prefix-summed along it, one random offset is added, and a document is emitted once
for each integer boundary its interval crosses. Because the order runs through size classes,
the words taken stay within about one document of the target. The order depends on the rows alone,
not on how they are stored, and copies are counted in integers (units of 2^-24), so reruns agree.

Scale: the prefix sum has two levels. Counts per (source, size class, salt) are pre-aggregated
and prefix-summed; rows are only numbered inside such a cell, so that a source with a third of
all rows is spread over classes x salts tasks. The salt is the head of the digest, so it splits
any ids evenly, and its length follows from the number of rows without changing the order. The report counts
words in one scan and then moves digests and sizes only; ``mix`` moves each text once. Windows over
sources alone hold one row per source: sources are names of collections, at most some millions.

Edge cases: a null text has size 0 and can still be emitted (it adds nothing); a null source is
a source of its own, last in order; sources without words get target 0 and no copies; a null id
differs from every other; repeated rows are separate documents and interchangeable; a very long
text is one document; other columns travel packed and cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import WORD
from lintel.plans.storage import materialize

UNIT_BITS = 24
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Bit length and the three bits after the leading one: classes about 12 % wide."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 8 + F.call_function("shiftright", size, bits - 4).bitwiseAND(7)).cast("int")


def source_targets(totals: DataFrame, share: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Water-filling in one pass of windows over one row per source.

    In order of cap / weight, a source is capped as long as its cap lies below the level that
    the rest would get; ``rate`` is the expected copies in units of 2^-24.
    """
    everything = Window.partitionBy()
    ordered = totals.withColumn("rank", F.row_number().over(Window.orderBy("s_null", "s_key")) - 1)
    ordered = ordered.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("double"))
    ordered = ordered.withColumn("top", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("top") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ordered = ordered.withColumn("total", total).withColumn("capped", F.col("top") / F.col("w") <= level)
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("top")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("capped"), F.col("top")).otherwise(left / free * F.col("w"))
    rate = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size") * F.lit(float(1 << UNIT_BITS)) + 0.5))
    return ordered.withColumn("target", target).select(
        "s_null", "s_key", "rank", "source_size", "target", F.least(rate.cast("long"), F.lit(int(cap * (1 << UNIT_BITS)))).alias("rate")
    )


def order_digest() -> Column:
    """A row's place among those of its size class: equal for equal rows only, and evenly spread."""
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), text).cast("binary"))


def _sized(docs: DataFrame, row: Column) -> DataFrame:
    source = F.col("source")
    return docs.select(row.alias("_row"), source.isNull().alias("s_null"), F.coalesce(source, F.lit("")).alias("s_key"), n_words(F.col("text")).alias("size"), order_digest().alias("digest"))


def plan(rows: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, cap: float = 2.0, seed: int = 20011, cell_rows: int = 100_000) -> DataFrame:
    """Rows of :func:`_sized` with source_size, target, copies and taken.

    ``cell_rows`` is how many of a size class's rows should share a salt, were all rows in one class.
    """
    digits = max(1, math.ceil(math.log(max(1, rows.count() / cell_rows), 16)))
    rows = rows.withColumn("cls", size_class(F.col("size"))).withColumn("salt", F.substring("digest", 1, digits))
    cell = ["s_null", "s_key", "cls", "salt"]
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    cells = materialize(cells, "cells")
    sources = source_targets(cells.groupBy("s_null", "s_key").agg(F.sum("words").alias("source_size")), share, weights, cap)
    by_class = cells.groupBy("s_null", "s_key", "cls").agg(F.sum("n").alias("n"))
    smaller = Window.partitionBy("s_null", "s_key").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    lower = by_class.select("s_null", "s_key", "cls", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("lower"))
    earlier = Window.partitionBy("s_null", "s_key", "cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("inner")).join(lower, cell[:3])
    cells = cells.withColumn("before", F.col("lower") + F.col("inner")).drop("lower", "inner").join(sources, ["s_null", "s_key"])
    inside = Window.partitionBy(*cell).orderBy("digest")
    placed = rows.withColumn("k", F.row_number().over(inside)).join(cells, cell)
    k = F.col("before") + F.col("k")
    offset = (F.col("rank").cast("long") * 10368889 + seed) % (1 << UNIT_BITS)
    copies = F.shiftright(k * F.col("rate") + offset, UNIT_BITS) - F.shiftright((k - 1) * F.col("rate") + offset, UNIT_BITS)
    return placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the documents of ``docs``, each as often as the mix takes it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    planned = plan(_sized(docs, whole), **options).where("copies > 0")
    return planned.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """The contract's rows: doc_id, size, source_size, target, taken, copies."""
    slim = materialize(_sized(docs, F.col("doc_id")), "sizes")
    return plan(slim, **options).select(F.col("_row").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ' ' || coalesce(md5(text), '-')) AS digest
  FROM documents),
c AS (
  SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END AS cls
  FROM d),
s AS (
  SELECT coalesce(source, '') AS k, source IS NULL AS n, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY 1, 2),
r AS (
  SELECT *, row_number() OVER (ORDER BY n, k) - 1 AS rank FROM s),
w AS (
  SELECT *, CAST([5, 2, 1][CAST(rank % 3 + 1 AS INTEGER)] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS top FROM r),
p AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(top) OVER (ORDER BY top / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tb,
         coalesce(sum(w) OVER (ORDER BY top / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb,
         sum(w) OVER () AS wa FROM w),
q AS (SELECT *, top / w <= (total - tb) / (wa - wb) AS capped FROM p),
t AS (
  SELECT *, CASE WHEN capped THEN top ELSE (total - sum(CASE WHEN capped THEN top ELSE 0 END) OVER ())
         / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () * w END AS target FROM q),
u AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / source_size * {1 << UNIT_BITS} + 0.5) AS BIGINT), {2 << UNIT_BITS}) END AS rate,
         (rank * 10368889 + 20011) % {1 << UNIT_BITS} AS off FROM t),
x AS (
  SELECT c.doc_id, c.size, u.source_size, u.target, u.rate, u.off,
         row_number() OVER (PARTITION BY u.k, u.n ORDER BY cls, digest) AS i
  FROM c JOIN u ON coalesce(c.source, '') = u.k AND (c.source IS NULL) = u.n),
y AS (SELECT *, ((i * rate + off) >> {UNIT_BITS}) - (((i - 1) * rate + off) >> {UNIT_BITS}) AS copies FROM x)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM y
"""
