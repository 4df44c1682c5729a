"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a hash string of 32 hyperplane signs and keeps the strings sorted.
A query descends in each tree to its longest prefix matches; then all trees ascend together, one
prefix length at a time, until the matches number at least ``want``. Those candidates are ranked
by exact inner products. Inner products of vectors of different norms are turned into angles
by one more component, sqrt(M^2 - |x|^2) with M the largest norm.

``want`` is calibrated, not guessed: up to ``sample`` queries (a documented bound) are answered
exactly against all rows, which gives for every prefix length the candidates and the share of
true neighbours found; the smallest ``want`` that reaches ``aim`` is taken. On vectors without
structure this approaches a full scan; on clustered ones it stays small.

Scale: the trees are partitioned by (tree, prefix); prefixes that no query has drop out, crowded ones
are salted, many queries at one prefix are dealt in blocks, and counts and rankings add up over salts and
blocks, so a task holds at most ``crowd`` vectors and ``asks`` queries. Vectors move as they were
stored, once per tree in which a query asks for their prefix. Equal vectors are one class with their k + 1 smallest ids, and equal
queries are answered once. The prefix is as long as nine tenths of the sampled queries allow (``SPARSE``). The queries that
have fewer than ``want`` matches there ascend on in a second partitioning by half of it, which only they pay for, and those
that fall short there too, find fewer than k, or ascend to the root are compared with every row: one pass for all of them, by (salt of rows, block of queries).

Edge cases: null, zero or non-finite vectors and vectors of another length than the commonest
take no part, nor do rows with a null id; rows that share an id are one candidate, a query never finds its own
id; ties go to the smaller id; with fewer than k candidates all are returned; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import two_hashes
from lintel.llm.vectors import common_length, matrix, pack, planes, usable
from lintel.plans.storage import materialize

BITS, TREES = 32, 10
#: Share of the sampled queries that may stop above the partitions' prefix.
SPARSE = 0.1
_TOP = np.dtype([("c1", "<i8"), ("c2", "<i8"), ("lo", "<i8"), ("score", "<f8")])


class _Forest:
    """The hash functions: signs of ``TREES * BITS`` hyperplanes on norm-augmented vectors."""

    def __init__(self, dims: int, largest: float, seed: int):
        self.dims, self.largest, self.seed = dims, largest, seed

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        w = planes(self.dims + 1, TREES * BITS, self.seed)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.largest**2 - (x * x).sum(axis=1)))
        return pack((np.c_[x, extra] @ w >= 0).reshape(len(x), TREES, BITS)).astype(np.int64)


def _prefix_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix lengths of pairs of 32-bit codes."""
    return BITS - np.ceil(np.log2((a ^ b).astype(np.float64) + 1)).astype(np.int64)


def _best(scores: np.ndarray, c1, c2, lo, k: int) -> np.ndarray:
    """The k best of one query as a structured array, best first, ties to the smaller id."""
    if len(scores) > 2 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge - 1e-9 * (1 + abs(edge)))
        scores, c1, c2, lo = scores[near], c1[near], c2[near], lo[near]
    out = np.zeros(len(scores), _TOP)
    out["c1"], out["c2"], out["lo"], out["score"] = c1, c2, lo, scores
    return out[np.lexsort((lo, -scores))[:k]] if len(out) > k else out


def _scan(forest: _Forest, k: int, queries: np.ndarray):
    """Exact answers of a bounded sample of queries over one partition, with prefix statistics."""

    def run(batches):
        codes = forest.codes(queries, True)
        best = [np.zeros(0, _TOP) for _ in queries]
        depth: list[dict] = [{} for _ in queries]
        counts = np.zeros((len(queries), BITS + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"), forest.dims)
            c1, c2, lo = (batch.column(c).to_numpy() for c in ("c1", "c2", "lo"))
            own = forest.codes(x, False)
            place = {c: n for n, c in enumerate(zip(c1.tolist(), c2.tolist(), strict=True))}
            for i, q in enumerate(queries):
                found = _best((x * q).sum(axis=1), c1, c2, lo, k)
                shared = _prefix_lengths(own, codes[i][None, :])
                counts[i] += np.bincount(shared.ravel(), minlength=BITS + 1)[::-1].cumsum()[::-1]
                depth[i] |= {c: int(shared[place[c]].max()) for c in zip(found["c1"].tolist(), found["c2"].tolist(), strict=True)}
                both = np.concatenate([best[i], found])
                best[i] = both[np.lexsort((both["lo"], -both["score"]))[:k]]
        at = [(i, b) for i in range(len(queries)) for b in best[i]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in at], pa.int64()),
                *[pa.array([b[c].item() for _, b in at], pa.float64() if c == "score" else pa.int64()) for c in ("c1", "c2", "lo", "score")],
                pa.array([depth[i].get((b["c1"].item(), b["c2"].item()), 0) for i, b in at], pa.int64()),
                pa.array([counts[i].tolist() if n == 0 or at[n - 1][0] != i else None for n, (i, _) in enumerate(at)], pa.list_(pa.int64())),
            ],
            ["q", "c1", "c2", "lo", "score", "depth", "counts"],
        )

    return run


_SCANNED = "q long, c1 long, c2 long, lo long, score double, depth long, counts array<bigint>"


def calibrate(classes: DataFrame, queries: DataFrame, forest: _Forest, k: int, sample: int, aim: float) -> tuple[int, int]:
    """(want, depth): candidates to gather, and the prefix length by which to partition."""
    picked = queries.orderBy(F.xxhash64("c1", "c2"), "c1").limit(sample).collect()
    vectors = np.array([r["vec"] for r in picked], np.float64)
    raw = materialize(classes.mapInArrow(_scan(forest, k + 1, vectors), _SCANNED), "calibration")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "lo", "c1", "c2")
    tops = raw.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1).select("q", "c1", "c2", "depth").collect()  # sample x (k + 1) rows
    sums = raw.where("counts is not null").select("q", F.posexplode("counts").alias("d", "n")).groupBy("q", "d").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(picked), BITS + 1), np.int64)
    for r in sums:
        counts[r["q"], r["d"]] = r["n"]
    reach: list[list[int]] = [[] for _ in picked]
    for r in tops:
        if (r["c1"], r["c2"]) != (picked[r["q"]]["c1"], picked[r["q"]]["c2"]):
            reach[r["q"]].append(r["depth"])
    want = 64
    while True:
        depths = [max([d for d in range(BITS + 1) if c[d] >= want], default=0) for c in counts]
        shares = [np.mean([x >= d for x in found]) for d, found in zip(depths, reach, strict=True) if found]
        if not shares or np.mean(shares) >= aim or not any(depths):
            return want, int(np.quantile(depths, SPARSE, method="lower")) if depths else 0
        want = want * 5 // 4 + 1


def _keys(forest: _Forest, depth: int, query: bool, trees: int):
    def run(batches):
        for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
            n = batch.num_rows
            if not n:
                continue
            codes = forest.codes(matrix(batch.column("vec"), forest.dims), query)[:, :trees].ravel() if depth or trees > 1 else np.zeros(n, np.int64)
            row = pa.array(np.repeat(np.arange(n), trees))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(row) for c in ("c1", "c2", "lo", "vec")] + [pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(codes >> (BITS - depth)), pa.array(codes)],
                ["c1", "c2", "lo", "vec", "tree", "prefix", "code"],
            )

    return run


def _ranges(codes: np.ndarray, query: np.ndarray, depth) -> tuple[np.ndarray, np.ndarray]:
    """In sorted codes, the range that shares ``depth`` first bits with each query."""
    free = (np.int64(1) << (BITS - np.asarray(depth, np.int64))) - 1
    return np.searchsorted(codes, query & ~free, "left"), np.searchsorted(codes, query | free, "right")


def _count(low: int):
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("ask").to_numpy(zero_copy_only=False)
        code = group.column("code").to_numpy()
        codes, query = np.sort(code[~asks]), code[asks]
        n = np.zeros((len(query), BITS + 1), np.int64)
        for d in range(low, BITS + 1):
            lo, hi = _ranges(codes, query, d)
            n[:, d] = hi - lo
        only = pa.array(asks)
        return pa.table({"c1": group.column("c1").filter(only), "c2": group.column("c2").filter(only), "n": pa.array(list(n), pa.list_(pa.int64()))})

    return run


def _search(dims: int, k: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group.column("ask").to_numpy(zero_copy_only=False)
        code, c1, c2, lo, depth = (group.column(c).to_numpy() for c in ("code", "c1", "c2", "lo", "depth"))
        x = matrix(group.column("vec").chunk(0), dims)
        rows, at = np.flatnonzero(~asks), np.flatnonzero(asks)
        rows = rows[np.argsort(code[rows], kind="stable")]
        left, right = _ranges(code[rows], code[at], depth[at])
        found = {}
        for i in range(len(at)):
            found.setdefault((left[i], right[i]), []).append(i)
        tops, asker = [np.zeros(0, _TOP)], [np.zeros(0, np.int64)]
        for (a, b), who in found.items():
            if a == b:
                continue
            near = rows[a:b]
            for part in range(0, len(who), 64):
                some = at[who[part : part + 64]]
                scores = x[some] @ x[near].T
                for i, s in zip(some, scores, strict=True):
                    tops.append(_best(s, c1[near], c2[near], lo[near], k))
                    asker.append(np.full(len(tops[-1]), i))
        top, by = np.concatenate(tops), pa.array(np.concatenate(asker))
        return pa.table({"q1": group.column("c1").take(by), "q2": group.column("c2").take(by), **{c: pa.array(np.ascontiguousarray(top[c])) for c in _TOP.names}})

    return run


def top_classes(found: DataFrame, k: int) -> DataFrame:
    """(q1, q2, c1, c2): the k best of each query over all trees, salts and blocks."""
    once = found.groupBy("q1", "q2", "c1", "c2").agg(F.max("score").alias("score"), F.min("lo").alias("lo"))
    order = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "lo"))
    return once.withColumn("rn", order).where(F.col("rn") <= k).select("q1", "q2", "c1", "c2")


def _dealt(classes: DataFrame, queries: DataFrame, forest: _Forest, depth: int, trees: int, crowd: int, asks: int) -> tuple[DataFrame, DataFrame]:
    """Rows and queries by (tree, prefix, salt, block): every query meets every row of its prefix in exactly one task."""
    held = classes.schema["vec"].dataType.simpleString()
    keyed = f"c1 long, c2 long, lo long, vec {held}, tree int, prefix long, code long"
    index = classes.select("c1", "c2", "lo", "vec").mapInArrow(_keys(forest, depth, False, trees), keyed)
    probes = queries.select("c1", "c2", "lo", "vec").mapInArrow(_keys(forest, depth, True, trees), keyed)
    sized = lambda rows, most, name: rows.groupBy("tree", "prefix").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    parts = sized(index, crowd, "salts").join(sized(probes, asks, "blocks"), ["tree", "prefix"])
    parts = F.broadcast(materialize(parts, "parts"))  # at most 10 x 4096 rows
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = index.join(parts, ["tree", "prefix"]).withColumn("salt", F.pmod("c2", F.col("salts")).cast("int")).withColumn("block", each("blocks")).withColumn("ask", F.lit(False))
    probes = probes.join(parts, ["tree", "prefix"]).withColumn("block", F.pmod("c1", F.col("blocks")).cast("int")).withColumn("salt", each("salts")).withColumn("ask", F.lit(True))
    return index, probes


_PART = ["tree", "prefix", "salt", "block"]
_SLIM = [*_PART, "code", "c1", "c2", "ask"]


def _searched(index: DataFrame, asking: DataFrame, forest: _Forest, k: int) -> DataFrame:
    """The k best classes of each query (with its ``depth``) among the rows that share so much of its code."""
    full = [*_SLIM, "lo", "vec"]
    both = index.select(*full).withColumn("depth", F.lit(0)).unionByName(asking.select(*full, "depth"))
    found = both.groupBy(*_PART).applyInArrow(_search(forest.dims, k), "q1 long, q2 long, c1 long, c2 long, lo long, score double")
    return materialize(top_classes(found, k), "found")


def ascend(classes: DataFrame, queries: DataFrame, forest: _Forest, k: int, want: int, depth: int, crowd: int, asks: int) -> tuple[DataFrame, DataFrame]:
    """(best, rest): the k best of the queries whose ascent ends at prefixes of ``depth`` or longer, and the queries for which it does not."""
    index, probes = _dealt(classes, queries, forest, depth, TREES, crowd, asks)
    counted = index.select(*_SLIM).unionByName(probes.select(*_SLIM)).groupBy(*_PART).applyInArrow(_count(depth), "c1 long, c2 long, n array<bigint>")
    summed = counted.groupBy("c1", "c2").agg(*[F.sum(F.col("n")[d]).alias(f"n{d}") for d in range(depth, BITS + 1)])
    stop = F.lit(None).cast("int")
    for d in range(max(1, depth), BITS + 1):  # at the root every row matches
        stop = F.when(F.col(f"n{d}") >= want, d).otherwise(stop)
    stops = materialize(summed.select("c1", "c2", stop.alias("depth")).where("depth is not null"), "depths")
    best = _searched(index, probes.join(stops, ["c1", "c2"]), forest, k)
    return best, materialize(queries.join(stops, ["c1", "c2"], "left_anti"), "rest")


def compare_all(classes: DataFrame, queries: DataFrame, forest: _Forest, k: int, crowd: int, asks: int) -> DataFrame:
    """The k best of every query among all rows, in one pass."""
    index, probes = _dealt(classes, queries, forest, 0, 1, crowd, asks)
    return _searched(index, probes.withColumn("depth", F.lit(0)), forest, k)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = 100, aim: float = 0.95, seed: int = 97, crowd: int = 65536, asks: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every``, their k nearest.

    ``sample`` bounds the queries of the calibration, ``crowd`` the vectors and ``asks`` the queries of one task.
    """
    h1, h2 = two_hashes(F.col("embedding"))
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding", h1.alias("c1"), h2.alias("c2"))
    dims = common_length(rows, "embedding")
    rows = rows.where(F.size("embedding") == dims).withColumnRenamed("embedding", "vec")
    # Ids of a class are first made distinct, each by itself; then every task keeps k + 1 of a class before the class meets.
    order = F.row_number().over(Window.partitionBy("c1", "c2").orderBy("vec_id"))
    members = rows.select("c1", "c2", "vec_id").distinct().withColumn("n", order).where(F.col("n") <= k + 1)
    members = members.groupBy("c1", "c2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = rows.groupBy("c1", "c2").agg(F.first("vec").alias("vec")).join(members, ["c1", "c2"])
    classes = materialize(classes.withColumn("lo", F.col("ids")[0]), "vector-classes")
    ids = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("c1").alias("q1"), F.col("c2").alias("q2")).distinct()
    asked = ids.select(F.col("q1").alias("c1"), F.col("q2").alias("c2")).distinct()
    queries = materialize(asked.join(classes, ["c1", "c2"]), "queries")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    stats = classes.agg(F.max(square).alias("m")).first()
    empty = "query_id {0}, rank int, vec_id {0}, score double".format(vectors.schema["vec_id"].dataType.simpleString())
    if stats["m"] is None or not queries.limit(1).count():
        return vectors.sparkSession.createDataFrame([], empty)
    forest = _Forest(dims, float(np.sqrt(stats["m"])), seed)
    want, depth = calibrate(classes, queries, forest, k, sample, aim)
    depth = min(depth, 12)  # at most 10 x 4096 partitions' sizes are looked up
    best, rest = ascend(classes, queries, forest, k + 1, want, depth, crowd, asks)
    if depth > 1 and not rest.isEmpty():
        more, rest = ascend(classes, rest, forest, k + 1, want, depth // 2, crowd, asks)
        best = best.unionByName(more)
    total = classes.agg(F.sum(F.size("ids"))).first()[0]
    got = best.join(classes.select("c1", "c2", F.size("ids").alias("m")), ["c1", "c2"]).groupBy("q1", "q2").agg(F.sum("m").alias("m"))
    enough = got.where(F.col("m") >= min(k + 1, total)).select(F.col("q1").alias("c1"), F.col("q2").alias("c2"))
    poor = materialize(queries.join(enough, ["c1", "c2"], "left_anti"), "poor")  # ``rest`` among them
    if not poor.isEmpty():
        best = best.unionByName(compare_all(classes, poor, forest, k + 1, crowd, asks)).distinct()
    # Final scores in one fixed order of summation, ids in place of classes.
    own = queries.select(F.col("c1").alias("q1"), F.col("c2").alias("q2"), F.col("vec").alias("qv"))
    scored = best.join(classes.select("c1", "c2", "ids", "vec"), ["c1", "c2"]).join(own, ["q1", "q2"])
    dot = F.aggregate(F.zip_with("vec", "qv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    named = scored.select("q1", "q2", dot.alias("score"), F.explode("ids").alias("vec_id"))
    few = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id"))
    named = named.withColumn("rn", few).where(F.col("rn") <= k + 1).drop("rn")
    out = ids.join(named, ["q1", "q2"]).where("vec_id <> query_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
