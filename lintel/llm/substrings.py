"""Suffix-array dedup: remove every byte covered by a repeated 200-byte string.

1. Seeds. In every 200-byte window the k-gram of smallest hash (its minimizer) is found; windows with
   the same minimizer are neighbours and make one stretch of bytes. Equal windows have equal
   minimizers, so only stretches that share a minimizer can hold a common window. Stretches that
   are equal as a whole are copies: they collapse to one, repeat all their windows and need no further
   look; minimizers seen in one stretch only cannot repeat.
2. Intervals. What is left (stretches that share a minimizer but differ) is gathered by minimizer.
   A suffix array of the distinct stretches gives the Burrows-Wheeler transform; breadth-first
   backward extension from the empty string derives the boundaries between suffixes by
   increasing common prefix, and stops at the minimum length. Suffixes with no boundary between
   them then share at least that many bytes: their windows repeat.
3. Hot minimizers, with more stretches than one task should hold, are decided by exact hashes of
   their windows, counted with partial aggregation. It is the exact way for what the bound leaves.

Scale: linear in the input; seeds are about one row per 77 bytes, texts move twice, keyed by row.
Hashes of bytes are 64-bit per minimizer and 64-bit per stretch, so both must collide at once; rows
are known by 128 bits. The places of a hot minimizer are one side of a join of two written or shuffled
tables, which adaptive execution splits.

Edge cases: a null text is empty; texts under the minimum length keep all bytes; rows that repeat id and
text are two places; a null id is kept; a very long text is seeded in slices of 4 MiB, so that memory
and positions stay bounded; columns besides doc_id and text are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import wide_row_key
from lintel.llm.textkernels import mix, powers, prefix_hash, range_hash, sliding_min
from lintel.plans.storage import materialize, small_batches

GRAM = 48
_LOW = np.uint64((1 << 28) - 1)


def _stretches(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    a = np.frombuffer(text, np.uint8)
    if len(a) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = prefix_hash(a)
    n = len(a) - gram + 1
    grams = mix((h[gram:] - h[:-gram]) * powers(len(h))[1][:n])
    at = np.arange(n, dtype=np.uint64)
    best = sliding_min((grams & ~_LOW) | (at & _LOW), length - gram + 1) & _LOW
    first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    last = np.concatenate((first[1:], [len(best)])) - 1
    where = best[first].astype(np.int64)
    whole = range_hash(h, first, last + length) ^ mix((where - first).astype(np.uint64))
    return grams[where].view(np.int64), whole.view(np.int64), first, last, where


def stretches(text: bytes, length: int, gram: int, part: int = 1 << 22) -> tuple[np.ndarray, ...]:
    """(minimizer hash, stretch hash, first window, last window, minimizer position) per stretch.

    Every window start lies in exactly one stretch; a stretch's bytes are [first, last + length).
    ``part`` bounds the windows that are looked at together.
    """
    found = [_stretches(text[at : at + part + length - 1], length, gram) for at in range(0, max(1, len(text) - length + 1), part)]
    if len(found) == 1:
        return found[0]
    m, w, *places = zip(*found, strict=True)
    return np.concatenate(m), np.concatenate(w), *(np.concatenate([x + i * part for i, x in enumerate(c)]) for c in places)


def _seeds(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = [stretches((t or "").encode("utf-8", "surrogatepass"), length, gram) for t in some.column("text").to_pylist()]
                row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                if len(row):
                    m, w, first, last, _ = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(w), some.column("rid").take(pa.array(row)), pa.array((first << 16) | (last - first))], ["m", "w", "rid", "at"])

    return run


def suffix_array(text: np.ndarray, bound: int) -> np.ndarray:
    """Suffixes of an array of symbols below 512, ordered by at least their first ``bound`` symbols.

    The first pass packs seven symbols in one key, then ranks are doubled.
    """
    n = len(text)
    key = np.zeros(n, np.int64)
    for j in range(min(7, n)):
        key[: n - j] |= text[j:] << np.int64(9 * (6 - j))
    reach = 7
    while True:
        order = np.argsort(key)
        step = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        if reach >= bound or step[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = step
        key = rank * (n + 1)
        key[: max(0, n - reach)] += rank[reach:] + 1
        reach *= 2


def boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each rank i, whether the suffixes at ranks i - 1 and i differ within ``length`` symbols.

    Breadth first over the Burrows-Wheeler transform: a queue holds the intervals of all strings of
    one length that opened a new boundary; each is extended backwards by every symbol before its
    suffixes; an extension whose right end is no boundary yet opens one and is queued.
    """
    n = len(text)
    before = text[order - 1]  # symbol 0 precedes the first suffix; it is a separator
    by_symbol = np.argsort(before.astype(np.uint16), kind="stable")  # LF mapping: rank of each extension
    extended = np.empty(n, np.int64)
    extended[by_symbol] = np.arange(n)
    mark = np.zeros(n + 1, bool)
    mark[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    symbols = int(text.max()) + 1
    for _ in range(length):
        sizes = hi - lo
        inside = np.repeat(lo - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        owner = np.repeat(np.arange(len(lo)), sizes)
        symbol, to = before[inside], extended[inside]
        key = owner * symbols + symbol
        first = np.argsort(key)
        edge = np.flatnonzero(np.concatenate(([True], key[first][1:] != key[first][:-1])))
        new_lo = np.minimum.reduceat(to[first], edge)  # extensions by one symbol are neighbours
        new_hi = new_lo + np.diff(np.concatenate((edge, [len(first)])))
        live = symbol[first][edge] > 0
        new_lo, new_hi = new_lo[live], new_hi[live]
        opened = ~mark[new_hi]
        lo, hi = new_lo[opened], new_hi[opened]
        mark[hi] = True
        if not len(lo):
            break
    return mark[:n]


def repeated_starts(pieces: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """Per piece, the starts of ``length``-byte strings that start at two places or more.

    A piece of weight over 1 stands for as many equal places.
    """
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]), np.int64)
    body = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text[:] = body.astype(np.int64) + 1
    text[ends - 1] = 0
    starts = ends - sizes - 1
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    left = ends[owner] - 1 - np.arange(len(text))  # symbols up to the piece's separator
    order = suffix_array(text, length)
    mark = boundaries(text, order, length)
    cls = np.cumsum(mark) - 1
    fits = left[order] >= length
    count = np.bincount(cls, weights=np.where(fits, weights[owner[order]], 0))
    hit = fits & (count[cls] > 1.5)
    where = np.sort(order[hit])
    cut = np.searchsorted(where, np.concatenate((starts, [len(text)])))
    return [where[cut[i] : cut[i + 1]] - starts[i] for i in range(len(pieces))]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)))
    return starts[edge], starts[np.concatenate((edge[1:], [len(starts)])) - 1]


def _shard(length: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        n, base = group.column("n").to_numpy(), group.column("at").to_numpy() >> 16
        row, at = [], []
        for i, starts in enumerate(repeated_starts(group.column("body").to_pylist(), n, length)):
            if n[i] == 1 and len(starts):
                a, b = _runs(starts)
                row += [i] * len(a)
                at += (((base[i] + a) << 16) | (b - a)).tolist()
        return pa.table({"rid": group.column("rid").take(pa.array(row, pa.int64())), "at": pa.array(at, pa.int64())})

    return run


def _windows(length: int):
    """One row per window of a stretch, with two independent 64-bit hashes."""

    def run(batches):
        for batch in batches:
            base = batch.column("at").to_numpy() >> 16
            row, at, x, y = [], [], [], []
            for i, body in enumerate(batch.column("body").to_pylist()):
                lo = np.arange(len(body) - length + 1)
                a = np.frombuffer(body, np.uint8)
                row.append(np.full(len(lo), i))
                at.append((base[i] + lo) << 16)
                x.append(range_hash(prefix_hash(a), lo, lo + length))
                y.append(range_hash(prefix_hash(a[::-1] ^ np.uint8(0x5A)), len(a) - lo - length, len(a) - lo))
            if row:
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid").take(take), batch.column("n").take(take), pa.array(np.concatenate(at)), pa.array(np.concatenate(x).view(np.int64)), pa.array(np.concatenate(y).view(np.int64))],
                    ["rid", "n", "at", "x", "y"],
                )

    return run


def _bodies(length: int):
    """Cut the asked stretches out of a row's text."""

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                asked = batch.column("asked")[i].as_py()
                body = (text or "").encode("utf-8", "surrogatepass")
                cut = [body[a["at"] >> 16 : (a["at"] >> 16) + (a["at"] & 0xFFFF) + length] for a in asked]
                rid = batch.column("rid").take(pa.array(np.full(len(asked), i)))
                yield pa.RecordBatch.from_arrays([rid, *[pa.array([a[c] for a in asked], pa.int64()) for c in ("m", "n", "held", "at")], pa.array(cut, pa.binary())], ["rid", "m", "n", "held", "at", "body"])

    return run


def merged(spans: list, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows; each number is a first start and how many follow it."""
    out: list[list[int]] = []
    for at in sorted(spans):
        lo = at >> 16
        hi = lo + (at & 0xFFFF) + length
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _finish(length: int, with_text: bool):
    def run(batches):
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                body = (text or "").encode("utf-8", "surrogatepass")
                gone = merged(found or [], length)
                left, at = [], 0
                for a, b in gone:
                    left.append(body[at:a])
                    at = b
                left.append(body[at:])
                rest = b"".join(left)
                sizes.append(len(body))
                removed.append(len(body) - len(rest))
                spans.append(len(gone))
                kept.append(rest.decode("utf-8", "replace") if with_text else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (sizes, removed, spans)], pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, hot: int = 3000, shard_stretches: int = 3000, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the SHA-256 of the bytes left, or with ``with_text`` the text left.

    ``hot`` bounds the stretches of one minimizer that meet in a shard; ``shard_stretches`` sizes shards.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", wide_row_key(F.col("doc_id"), F.col("text")).alias("rid"))
    seeds = rows.mapInArrow(_seeds(length, gram), "m long, w long, rid binary, at long")
    # Minimizers at two places or more, and whether their stretches differ.
    often = seeds.groupBy("m").agg(F.count(F.lit(1)).alias("places"), F.min("w").alias("lo"), F.max("w").alias("hi")).where("places > 1")
    often = materialize(often, "often")
    live = materialize(seeds.join(often.select("m", (F.col("lo") != F.col("hi")).alias("mixed")), "m"), "stretches")
    kinds = live.groupBy("m", "w", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "at")).alias("one"))
    kinds = materialize(kinds, "kinds")
    whole = live.join(kinds.where("n > 1").select("m", "w"), ["m", "w"]).select("rid", "at")
    held = kinds.where("mixed").groupBy("m").agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("least")).where("least = 1").select("m", "held")
    asked = kinds.where("mixed").join(held, "m").select(F.col("one.rid").alias("key"), F.struct("m", "n", "held", "one.at").alias("a"))
    asked = asked.groupBy("key").agg(F.collect_list("a").alias("asked"))
    cut = rows.join(asked, F.col("rid") == F.col("key")).select("rid", "text", "asked")
    bodies = cut.mapInArrow(_bodies(length), "rid binary, m long, n long, held long, at long, body binary")
    bodies = materialize(bodies.dropDuplicates(["rid", "m", "at"]), "bodies")
    cold = bodies.where(F.col("held") <= hot)
    shards = max(1, -(-cold.count() // shard_stretches))
    by_interval = cold.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards))).groupBy("shard").applyInArrow(_shard(length), "rid binary, at long")
    windows = bodies.where(F.col("held") > hot).mapInArrow(_windows(length), "rid binary, n long, at long, x long, y long")
    repeats = windows.groupBy("x", "y").agg(F.sum("n").alias("n")).where("n > 1").select("x", "y")
    by_hash = windows.where("n = 1").join(repeats, ["x", "y"]).select("rid", "at")
    found = whole.unionByName(by_interval).unionByName(by_hash)
    found = found.groupBy("rid").agg(F.collect_list("at").alias("found")).withColumnRenamed("rid", "key")
    joined = rows.join(found, F.col("rid") == F.col("key"), "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_finish(length, with_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept string")


def substring_report(docs: DataFrame, **options) -> DataFrame:
    """The contract's rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, **options).withColumnRenamed("kept", "kept_sha256")
