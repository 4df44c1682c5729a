"""Containment in document trees as equi joins.

An element's subtree is the run of places (ord, last_ord]. The run is cut in aligned blocks of 1, 8, 64, ... places, each
place in exactly one of them, and a place is known by the block that holds it on every level. So an element and what is
below it meet in exactly one block, and (page_id, level, block) is a join key: a page of millions of elements is many keys, which
one per page would not be.

Nearest ancestors and tallies of descendants never make pairs: either side is summed up per block before the join.

Edge cases: childless elements hold nothing; pages of any length work (beyond 8^7 places with more blocks of the largest size); equal
page ids are one page; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BITS = 3
_TOP = 6
_BLOCKS = "array<struct<level:int,block:bigint>>"
_KEY = ("page_id", "level", "block")
#: Places, as a power of two, that are put in order together before the first of them are kept.
_RUN = 9


def blocks_of(place: Column) -> Column:
    """The block of every level that holds a place."""
    at = place.cast("long")
    return F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(at, _BITS * level).alias("block")) for level in range(_TOP + 1)])


def cover(low: Column, high: Column) -> Column:
    """Blocks that together hold the places from ``low`` to ``high``, each once; none where ``low`` is above ``high``."""
    none = F.array().cast(_BLOCKS)
    size = 1 << _BITS

    def run(level: Column, a: Column, b: Column) -> Column:
        return F.when(a <= b, F.transform(F.sequence(a, b), lambda x: F.struct(level.cast("int").alias("level"), x.alias("block")))).otherwise(none)

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        up, down = F.shiftright(a + (size - 1), _BITS), F.shiftright(b + 1, _BITS) - 1
        done = (level == _TOP) | (up > down)
        edges = F.when(done, run(level, a, b)).otherwise(F.concat(run(level, a, up * size - 1), run(level, (down + 1) * size, b)))
        return F.struct(F.when(done, F.lit(1).cast("long")).otherwise(up).alias("a"), F.when(done, F.lit(0).cast("long")).otherwise(down).alias("b"), F.concat(acc["held"], edges).alias("held"))

    begin = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), none.alias("held"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_TOP)), begin, step, lambda acc: acc["held"])


def _covering(outer: DataFrame, *keep: Column) -> DataFrame:
    held = outer.where(F.col("last_ord") > F.col("ord"))
    return held.select("page_id", F.col("ord").alias("o_ord"), *keep, F.explode(cover(F.col("ord") + 1, F.col("last_ord"))).alias("b")).select("*", "b.level", "b.block").drop("b")


def _placed(inner: DataFrame, *keep: Column) -> DataFrame:
    return inner.select("page_id", F.col("ord").alias("i_ord"), *keep, F.explode(blocks_of(F.col("ord"))).alias("b")).select("*", "b.level", "b.block").drop("b")


def nearest_above(inner: DataFrame, outer: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(page_id, ord, o_ord, keep...): for each row of ``inner`` (page_id, ord) the nearest row of ``outer`` (page_id, ord, last_ord) that it
    stands in; rows that stand in none are absent."""
    keep = keep or []
    held = F.struct("o_ord", *keep)
    best = _covering(outer, *map(F.col, keep)).groupBy(*_KEY).agg(F.max_by(held, "o_ord").alias("o"))
    met = _placed(inner).join(best, list(_KEY))
    return met.groupBy("page_id", F.col("i_ord").alias("ord")).agg(F.max_by("o", F.col("o.o_ord")).alias("o")).select("page_id", "ord", "o.*")


def count_below(outer: DataFrame, inner: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(page_id, ord, by..., n): how many rows of ``inner`` stand in each row of ``outer``, per value of ``by``; rows without any are absent."""
    by = by or []
    placed = _placed(inner, *map(F.col, by)).groupBy(*_KEY, *by).agg(F.count(F.lit(1)).alias("n"))
    met = _covering(outer).join(placed, list(_KEY))
    return met.groupBy("page_id", F.col("o_ord").alias("ord"), *by).agg(F.sum("n").alias("n"))


def pairs_below(outer: DataFrame, inner: DataFrame, outer_keep: list[str] | None = None, inner_keep: list[str] | None = None) -> DataFrame:
    """(page_id, o_ord, i_ord, kept columns): every pair of an element and one below it, for few of either."""
    left = _covering(outer, *map(F.col, outer_keep or []))
    return left.join(_placed(inner, *map(F.col, inner_keep or [])), list(_KEY)).drop("level", "block")


def first_of(rows: DataFrame, keys: list[str], k: int, value: Column) -> DataFrame:
    """(keys..., n, first): how many rows a group has and the ``k`` of them with the smallest ``ord``, as (ord, value) in order.

    Runs of 512 places keep their first ``k`` before groups meet, so a group of any size moves few rows; rows must differ in ``ord`` within a group.
    """
    first = lambda held: F.slice(F.array_sort(held), 1, k).alias("first")
    item = F.struct("ord", value.alias("value"))
    runs = rows.groupBy(*keys, F.shiftright(F.col("ord").cast("long"), _RUN).alias("run")).agg(F.count(F.lit(1)).alias("n"), first(F.collect_list(item)))
    return runs.groupBy(*keys).agg(F.sum("n").alias("n"), first(F.flatten(F.collect_list("first"))))


def first_below(outer: DataFrame, inner: DataFrame, k: int, value: Column) -> DataFrame:
    """(page_id, ord, n, first): per row of ``outer`` how many rows of ``inner`` stand in it and the first ``k`` of them in document order, as
    :func:`first_of` gives them; rows without any are absent. A block sends at most ``k`` rows to each element that it is part of."""
    placed = first_of(_placed(inner, value.alias("value")).withColumnRenamed("i_ord", "ord"), list(_KEY), k, F.col("value"))
    met = _covering(outer).join(placed, list(_KEY)).groupBy("page_id", F.col("o_ord").alias("ord"))
    return met.agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, k).alias("first"))


def flags_above(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(page_id, ord, flags): for each row of ``inner`` the bits that the rows of ``outer`` (with a column ``flags``) around it have; rows in none are absent."""
    held = _covering(outer, F.col("flags")).groupBy(*_KEY).agg(F.bit_or("flags").alias("flags"))
    return _placed(inner).join(held, list(_KEY)).groupBy("page_id", F.col("i_ord").alias("ord")).agg(F.bit_or("flags").alias("flags"))


def last_before(rows: DataFrame, marks: DataFrame, value: Column) -> DataFrame:
    """(page_id, ord, value): for each row the value of the last mark that begins before it, null without one.

    Runs of places are put in order each on its own, and what a run ends with is carried to those after it, so that one giant page is many tasks.
    """
    mark = F.struct(value.alias("value"))
    none = F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType)
    both = marks.select("page_id", "ord", mark.alias("m"), F.lit(1).alias("is_mark")).unionByName(rows.select("page_id", "ord", none.alias("m"), F.lit(0).alias("is_mark")))
    both = both.withColumn("run", F.shiftright(F.col("ord").cast("long"), _RUN))
    upto = Window.partitionBy("page_id", "run").orderBy("ord", "is_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("near", F.last("m", ignorenulls=True).over(upto)).where("is_mark = 0")
    ends = both.groupBy("page_id", "run").agg(F.max_by("m", F.when(F.col("is_mark") == 1, F.col("ord"))).alias("end"))
    before = Window.partitionBy("page_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("page_id", "run", F.last("end", ignorenulls=True).over(before).alias("carried"))
    return near.join(ends, ["page_id", "run"]).select("page_id", "ord", F.coalesce("near", "carried")["value"].alias("value"))
