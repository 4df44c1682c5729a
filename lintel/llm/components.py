"""Connected components with joins: alternating large and small stars.

Vertices may be of any type that Spark can order and hash. Each round pulls vertices towards
the smallest vertex of their neighbourhood; the forest reaches one star per component in about
log(n) rounds. Only edges move; nothing is collected but a few numbers per round. A vertex with
very many edges is one side of an inner join, which adaptive execution splits when it is skewed.
As soon as the edges left are fewer than a fixed bound, one task finishes them by union-find: its
memory is bounded by that number at any size of the input.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.plans.storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have v < u: every u keeps its smallest neighbour, the other neighbours hang below it."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _finish(group: pa.Table) -> pa.Table:
    """Stars of a bounded edge list by union-find; the smaller vertex is the root."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in zip(group.column("u").to_pylist(), group.column("v").to_pylist(), strict=True):
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
    stars = [(x, find(x)) for x in list(root)]
    stars = [(x, r) for x, r in stars if x != r]
    kind = group.schema.field("u").type
    return pa.table({"u": pa.array([x for x, _ in stars], kind), "v": pa.array([r for _, r in stars], kind)})


def connected_components(edges: DataFrame, max_rounds: int = 60, bound: int = 50_000) -> DataFrame:
    """(node, label) for every vertex of an edge; label is the component's smallest vertex.

    ``edges`` has columns u and v. Self-loops are ignored, an empty input gives an empty result.
    ``bound`` is the number of edges that one task may finish.
    """
    first = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    state, seen = materialize(first, "edges"), None
    for _ in range(max_rounds):
        n = state.count()
        if n <= bound:
            kind = state.schema["u"].dataType.simpleString()
            older, state = state, materialize(state.groupBy(F.lit(0).alias("one")).applyInArrow(_finish, f"u {kind}, v {kind}"), "edges")
            discard(older)
            break
        mark = tuple(state.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) + (n,)
        if mark == seen:
            break
        seen = mark
        older, state = state, materialize(_small_star(_large_star(state)), "edges")
        discard(older)
    else:
        raise RuntimeError("connected components did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
