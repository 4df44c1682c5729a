"""Embedding near-dedup: hyperplane sign hashing in several tables, exact cosine, components.

Equal vectors of a label are one class from the start. Every class is hashed by ``bits`` signs in
each of several tables; bits grow with the logarithm of the classes so that buckets stay small,
and the number of tables follows from bits so that a pair at the threshold is missed with a
chance below ``miss``. Inside a bucket the cosines are exact (double precision). A pair is
counted only in the first table where its codes agree, so links are counted without emitting
pairs; per bucket only a spanning forest goes on to the distributed components.

Scale: what is shuffled per class and table is its key, its copies and the vector as it was stored;
the codes of the other tables are computed again where a bucket is compared. They come from whole
numbers (vector and planes rounded to fixed steps), so they are equal wherever they are computed.
Buckets of about a thousand keep the tables few: 143 at 10^9 classes and cosine 0.93. Buckets without
a partner drop out before vectors move. Small buckets share tasks' groups.

Skew: buckets over ``tile`` rows are cut into blocks and handled as pairs of blocks, so memory is
bounded; each row's counts add up over them.

Edge cases: vectors that are null, zero, or hold null or non-finite components, vectors of
another length than the commonest, and rows without label link with nothing and are their own
component; repeated rows link with each other; ties in ids take the smallest; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import two_hashes
from lintel.llm.vectors import common_length, matrix, pack, planes, usable
from lintel.llm.components import connected_components
from lintel.plans.storage import materialize


def table_shape(classes: int, cosine: float, miss: float, crowd: int = 1024) -> tuple[int, int]:
    """(bits, tables) for a corpus of so many distinct vectors, ``crowd`` of them to a bucket."""
    bits = max(8, math.ceil(math.log2(max(2, classes) / crowd)))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


@lru_cache(maxsize=2)
def _whole_planes(dims: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.rint(planes(dims, bits * tables, seed) * 2**14)


def sign_codes(x: np.ndarray, bits: int, tables: int, seed: int, first: int | None = None) -> np.ndarray:
    """(rows, tables) codes, or those of the ``first`` tables. Sums of whole numbers below 2^53 are exact in any order of summation."""
    scale = 2 ** math.floor(30 - math.log2(x.shape[1]) / 2)
    steps = np.rint(x * (scale / np.abs(x).max(axis=1))[:, None])
    some = tables if first is None else first
    return pack((steps @ _whole_planes(x.shape[1], bits, tables, seed)[:, : bits * some] >= 0).reshape(len(x), some, bits)).astype(np.int64)


def _index(dims: int, bits: int, tables: int, seed: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                codes = sign_codes(matrix(some.column("vec"), dims), bits, tables, seed)
                row = pa.array(np.repeat(np.arange(len(codes)), tables))
                yield pa.RecordBatch.from_arrays([some.column("node").take(row), some.column("label").take(row), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(codes))), pa.array(codes.ravel())], ["node", "label", "tab", "code"])

    return run


def _bucket_links(x: np.ndarray, codes: np.ndarray, tab: int, copies: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float):
    """(copies linked, root) per row of one bucket: left rows against right rows, each pair in its first table only."""
    n = len(x)
    links, root = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        a, b = np.nonzero(x[rows] @ x[right].T >= cosine)
        a, b = rows[a], right[b]
        if left is right:
            a, b = a[a < b], b[a < b]
        fresh = np.ones(len(a), bool)
        for t in range(tab):
            fresh &= codes[a, t] != codes[b, t]
        a, b = a[fresh], b[fresh]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        while len(a):
            lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = lo < hi
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, hi[apart], lo[apart])
            while (root != root[root]).any():
                root = root[root]
    return links, root


def _compare(dims: int, bits: int, tables: int, seed: int, cosine: float):
    """All buckets of a group, one after the other."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        raw = matrix(group.column("vec").chunk(0), dims)
        label, tab, code, ti, tj, block, copies = (group.column(c).to_numpy() for c in ("label", "tab", "code", "ti", "tj", "block", "copies"))
        order = np.lexsort((tj, ti, code, tab, label))
        same = np.ones(len(order), bool)
        for c in (label, tab, code, ti, tj):
            same[1:] &= c[order][1:] == c[order][:-1]
        same[:1] = False
        edge = np.append(np.flatnonzero(~same), len(order))
        links, root = np.zeros(len(order), np.int64), np.arange(len(order))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo < 2:
                continue
            at = order[lo:hi]
            x = raw[at] / np.sqrt((raw[at] * raw[at]).sum(axis=1))[:, None]
            codes = sign_codes(raw[at], bits, tables, seed, int(tab[at[0]]))
            left = np.flatnonzero(block[at] == ti[at[0]])
            right = left if ti[at[0]] == tj[at[0]] else np.flatnonzero(block[at] == tj[at[0]])
            links[at], found = _bucket_links(x, codes, int(tab[at[0]]), copies[at], left, right, cosine)
            root[at] = at[found]
        hit = np.flatnonzero((links > 0) | (root != np.arange(len(order))))
        node = group.column("node").chunk(0)
        return pa.table({"node": node.take(pa.array(hit)), "links": pa.array(links[hit]), "root": node.take(pa.array(root[hit]))})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, miss: float = 1e-5, tile: int = 4096, seed: int = 41, bits: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    h1, h2 = two_hashes(F.col("embedding"))
    fit = usable(F.col("embedding")) & F.col("label").isNotNull()
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"), fit.alias("fit"))
    dims = common_length(rows.where("fit"), "embedding")
    takes_part = F.col("fit") & (F.size("embedding") == dims)
    node = F.when(takes_part, F.unhex(F.format_string("%016x%016x%016x", "label", h1, h2)))
    rows = rows.select("vec_id", "label", node.alias("node"), "embedding")
    classes = rows.where("node is not null").groupBy("node", "label").agg(F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("vec"))
    classes = materialize(classes.select("node", "label", "copies", "vec"), "vector-classes")
    chosen, tables = table_shape(classes.count(), cosine, miss)
    if bits:
        chosen, tables = bits, math.ceil(math.log(miss) / math.log(1 - (1 - math.acos(cosine) / math.pi) ** bits))
    bucket = ["label", "tab", "code"]
    index = classes.select("node", "label", "vec").mapInArrow(_index(dims, chosen, tables, seed), "node binary, label long, tab int, code long")
    index = materialize(index, "codes")
    crowd = materialize(index.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "crowds")
    placed = index.join(crowd, bucket).withColumn("blocks", F.ceil(F.col("n") / tile).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("ti", F.least("block", "other")).withColumn("tj", F.greatest("block", "other"))
    # Buckets of one table and block pair share groups of about ``tile`` rows, large ones have their own.
    bins = F.greatest(F.lit(1), F.floor(F.lit(classes.count()) / tile)).cast("int")
    small = F.when(F.col("n") < tile / 4, F.pmod(F.xxhash64(*bucket), bins)).otherwise(F.xxhash64(*bucket))
    placed = placed.select("node", *bucket, "block", "ti", "tj", small.alias("bin"), (F.col("n") < tile / 4).alias("shared"))
    placed = placed.join(classes.select("node", "copies", "vec"), "node")
    found = placed.groupBy("tab", "shared", "bin", "ti", "tj").applyInArrow(_compare(dims, chosen, tables, seed, cosine), "node binary, links long, root binary")
    found = materialize(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v"))
    sizes = classes.select("node", "copies").join(links, "node", "left").join(labels.withColumnRenamed("label", "top"), "node", "left")
    facts = sizes.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("top", "node").alias("top"))
    members = rows.select("vec_id", "node").join(facts, "node", "left")
    least = members.where("top is not null").groupBy("top").agg(F.min("vec_id").alias("least")).withColumnRenamed("top", "of")
    out = members.join(least, F.col("top") == F.col("of"), "left")
    component = F.when(F.col("top").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS MATERIALIZED (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
b AS MATERIALIZED (
  SELECT p.vec_id AS x, q.vec_id AS y FROM g p JOIN g q ON p.label = q.label AND p.vec_id <> q.vec_id
  WHERE list_inner_product(p.e, q.e) / (p.n * q.n) >= 0.93),
c(x, l) AS (SELECT vec_id, vec_id FROM v UNION SELECT b.y, c.l FROM c JOIN b ON b.x = c.x),
m AS (SELECT x, min(l) AS l FROM c GROUP BY x),
k AS (SELECT x, count(*) AS n FROM b GROUP BY x)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.l AS component_id, vec_id = m.l AS kept
FROM v JOIN m ON m.x = v.vec_id LEFT JOIN k ON k.x = v.vec_id
"""
