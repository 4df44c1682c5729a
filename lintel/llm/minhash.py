"""MinHash near-dedup by a multi-index Hamming join.

Each text becomes its set of 5-word shingles. A signature keeps 16 bits of each of 50 min-hashes.
Signatures are split in 10 chunks of 5 symbols. If two signatures differ in at most 29 symbols,
some chunk differs in at most two (pigeonhole: 10 x 3 - 1); so each chunk is indexed under its 10 keys
that leave two symbols out, and every pair within distance 29 shares a key. That distance is the
threshold of the join: the index guarantees all pairs up to it, and candidates beyond it are
discarded. A pair of similarity 0.75 exactly lies beyond it with a chance of 1.6e-7, a more
similar one with a smaller chance. Candidates are verified on their full shingle sets.

Texts with equal sets are one class from the start. Within a bucket members are compared with one
hub per round and only with members of other components. Texts that still share a key across
components are re-bucketed by a prefix filter (their rarest shingles), which parts texts that
only have a common passage; hubs settle these buckets too. What is then still mixed is compared in
blocks of at most ``tile`` members, so no task holds a whole bucket, and only pairs within the distance
leave a block. Components are found by distributed stars; nothing but counts reaches the driver.

Sets are sets of 64-bit hashes of words and shingles (polynomial modulo 2^64 per word), classes
have 128-bit digests; texts written to collide words of 1,024 bytes and more could be mistaken.

Edge cases: null or empty texts have an empty set, link with nothing and form their own component;
an empty table gives an empty result; repeated rows are copies of each other; a null id never is a
component's id unless all ids in it are null; a very long text is hashed whole, in slices; columns
besides doc_id and text are not read, or pass through ``keep_one`` packed, so that none can clash.
"""

from __future__ import annotations

from collections import OrderedDict
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import WORD, boxed, row_key
from lintel.llm.textkernels import mix, shingle_set
from lintel.llm.components import connected_components
from lintel.plans.storage import discard, materialize, small_batches

SYMBOLS, CHUNK, ERRORS = 50, 5, 2
#: What the index guarantees: with one difference more, every chunk may hold ERRORS + 1.
DISTANCE = SYMBOLS // CHUNK * (ERRORS + 1) - 1
_rng = np.random.default_rng(20260101)
_A = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of the minima over a non-empty set."""
    least = np.full(SYMBOLS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(least, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return (mix(least ^ _B) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, 100) bucket keys: the chunk, which of its symbols are left out, and its other three symbols."""
    parts = signatures.reshape(len(signatures), -1, CHUNK).astype(np.int64)
    keys = []
    for c in range(parts.shape[1]):
        for a, b, d in combinations(range(CHUNK), CHUNK - ERRORS):
            keys.append((np.int64(len(keys)) << 48) | (parts[:, c, a] << 32) | (parts[:, c, b] << 16) | parts[:, c, d])
    return np.stack(keys, axis=1)


def _digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sets = [shingle_set(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("rid"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "rid", "n_shingles", "node", "sig"],
            )

    return run


def _bucket(batches):
    for batch in batches:
        nodes = batch.column("node").to_pylist()
        if nodes:
            keys = chunk_keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS))
            row = pa.array(np.repeat(np.arange(len(nodes)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("node").take(row)], ["key", "node"])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def _verify(width: int, percent: int):
    def run(batches):
        known: OrderedDict = OrderedDict()

        def of(node, text):
            if node not in known:
                known[node] = shingle_set(text, width)
                if len(known) > 64:
                    known.popitem(last=False)
            known.move_to_end(node)
            return known[node]

        for batch in batches:
            hit = []
            for u, v, tu, tv in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "tu", "tv")), strict=True):
                a, b = of(v, tv), of(u, tu)
                both = overlap(a, b)
                hit.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    return run


def _distance(a: str, b: str):
    """Differing 16-bit symbols of two signatures, given as binary columns."""
    same = [(F.substring(a, 2 * i + 1, 2) == F.substring(b, 2 * i + 1, 2)).cast("int") for i in range(SYMBOLS)]
    return SYMBOLS - sum(same[1:], same[0])


def _blocks(percent: int):
    """Pairs of two blocks of a bucket, across components, that distance, size and position allow; bucket by bucket."""

    def run(group: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        key, size, pos, block, ti, tj = (group.column(c).to_numpy() for c in ("key", "size", "pos", "block", "ti", "tj"))
        label = np.unique(np.array(group.column("label").to_pylist(), object), return_inverse=True)[1]
        order = np.lexsort((tj, ti, key))
        fresh = (key[order][1:] != key[order][:-1]) | (ti[order][1:] != ti[order][:-1]) | (tj[order][1:] != tj[order][:-1])
        edge = np.concatenate(([0], np.flatnonzero(fresh) + 1, [len(order)]))
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            at = order[lo:hi]
            left, right = at[block[at] == ti[at[0]]], at[block[at] == tj[at[0]]]
            step = max(1, (1 << 20) // max(1, len(right)))
            for some in (left[i : i + step] for i in range(0, len(left), step)):
                may = label[some][:, None] != label[right][None]
                if ti[at[0]] == tj[at[0]]:
                    may &= some[:, None] < right[None]
                need = -(-(size[some][:, None] + size[right][None]) * percent // (100 + percent))
                may &= (size[some][:, None] == 0) | (np.minimum((size[some] - pos[some])[:, None], (size[right] - pos[right])[None]) >= need)
                x, y = np.nonzero(may)
                x, y = some[x], right[y]
                for part in range(0, len(x), 1 << 16):
                    a, b = x[part : part + (1 << 16)], y[part : part + (1 << 16)]
                    near = (sig[a] != sig[b]).sum(axis=1) <= DISTANCE
                    u.append(a[near])
                    v.append(b[near])
        node = group.column("node").combine_chunks()
        return pa.table({"u": node.take(pa.array(np.concatenate(u))), "v": node.take(pa.array(np.concatenate(v)))})

    return run


_BUCKET = ("key", "node", "sig", "size", "pos")


class _Linker:
    """Finds links between classes of equal sets, bucket by bucket, and keeps the components."""

    def __init__(self, texts: DataFrame, width: int, percent: int, tile: int = 2048):
        self.texts, self.width, self.percent, self.tile = texts, width, percent, tile
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.tried: DataFrame | None = None

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of the (u, v) pairs those whose sets reach the threshold."""
        full = pairs.join(self.texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(self.texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
        return full.select("u", "v", "tu", "tv").mapInArrow(_verify(self.width, self.percent), "u binary, v binary")

    def mixed(self, buckets: DataFrame) -> DataFrame:
        """(key, node, label) of the buckets that still hold members of several components."""
        if self.labels is None:
            return buckets.select(*_BUCKET, F.col("node").alias("label"))
        rows = buckets.select(*_BUCKET).join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        return rows.join(several, "key").select(*_BUCKET, "label")

    def across(self, members: DataFrame, hubs: DataFrame, order: str = "true") -> DataFrame:
        """Pairs of a bucket's members with its hub and across components, but for those that the signatures'
        distance, or size and position, rule out; ``order`` is one more condition on a pair.

        With the first shared shingle at positions i and j no more than min(size - i) can be shared.
        """
        other = hubs.select("key", *[F.col(c).alias(f"v_{c}") for c in ("node", "sig", "label", "size", "pos")])
        need = F.ceil((F.col("size") + F.col("v_size")) * self.percent / F.lit(100 + self.percent))
        open_ = (F.col("size") == 0) | (F.least(F.col("size") - F.col("pos"), F.col("v_size") - F.col("v_pos")) >= need)
        near = members.join(other, (members["key"] == other["key"]) & (F.col("label") != F.col("v_label")) & F.expr(order) & open_ & (_distance("sig", "v_sig") <= DISTANCE))
        return near.select(F.col("node").alias("u"), F.col("v_node").alias("v"))

    def rest(self, members: DataFrame) -> DataFrame:
        """The same pairs among all members of the buckets that hubs left mixed, block by block."""
        counts = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "counts")
        bins = F.lit(max(1, counts.agg(F.sum("n")).first()[0] // self.tile))
        placed = members.join(counts, "key").withColumn("blocks", F.ceil(F.col("n") / self.tile).cast("int"))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # Small buckets share groups of about ``tile`` rows, large ones have a group for each pair of blocks.
        small = F.col("n") < self.tile / 4
        place = [small.alias("shared"), F.when(small, F.pmod(F.xxhash64("key"), bins)).otherwise(F.col("key")).alias("bin")]
        placed = placed.select(*_BUCKET, "label", "block", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), *place)
        return placed.groupBy("shared", "bin", "ti", "tj").applyInArrow(_blocks(self.percent), "u binary, v binary")

    def link(self, pairs: DataFrame) -> None:
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "pairs")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        new = materialize(self.verified(pairs), "links")
        self.links = new if self.links is None else self.links.unionByName(new)
        if self.labels is None or new.limit(1).count():
            self.labels = connected_components(self.links)

    def settle(self, buckets: DataFrame, rounds: int, turn: int) -> DataFrame | None:
        """Compare bucket members of other components with one hub per bucket and round.

        Returns what is still mixed after the rounds, or None when nothing is.
        """
        left = materialize(self.mixed(buckets), "open")
        for r in range(turn, turn + rounds):
            if not left.limit(1).count():
                return None
            pick = F.max_by(F.struct("node", "sig", "label", "size", "pos"), F.xxhash64(F.lit(r), "node")).alias("h")
            hubs = left.groupBy("key").agg(pick).select("key", "h.*")
            self.link(self.across(left, hubs))
            older, left = left, materialize(self.mixed(left), "open")
            discard(older)
        return left if left.limit(1).count() else None


def _tokens(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                sets = [shingle_set(t, width) for t in some.column("text").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                size = pa.array(np.repeat([len(s) for s in sets], [len(s) for s in sets]), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("node").take(row), size, pa.array(np.concatenate(sets).view(np.int64))], ["node", "size", "key"])

    return run


def _rare_buckets(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, node, size, pos) by prefix filter: sets that share ``percent`` of their union share one of the
    size - ceil(percent size) + 1 shingles that are rarest over all of ``texts``.

    Shingles that occur once use up prefix places but open no bucket.
    """
    tokens = texts.mapInArrow(_tokens(width), "node binary, size long, key long")
    often = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = tokens.join(often, "key")
    rows = shared.groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("t"))
    once = F.col("size") - F.size("t")
    places = F.col("size") - F.ceil(F.col("size") * percent / F.lit(100)) + 1 - once
    exploded = rows.where(places > 0).select("node", "size", once.alias("once"), F.posexplode(F.slice("t", F.lit(1), places.cast("int"))).alias("i", "x"))
    return exploded.select(F.col("x.key").alias("key"), "node", "size", (F.col("once") + F.col("i")).alias("pos"))


def components(docs: DataFrame, width: int = 5, percent: int = 75, hub_rounds: int = 4, tile: int = 2048) -> DataFrame:
    """(doc_id, rid, n_shingles, node, label): label names a row's component, null without words.

    ``label`` is a class digest; rows link if their sets share at least ``percent`` of their union.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").withColumn("rid", row_key(F.col("doc_id"), F.col("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = materialize(rows.mapInArrow(_describe(width), f"doc_id {kind}, rid long, n_shingles long, node binary, sig binary"), "signatures")
    classes = facts.where("n_shingles > 0").groupBy("node").agg(F.first("sig").alias("sig"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("r"))
    classes = materialize(classes.select("node", "sig", F.col("r.doc_id").alias("doc_id"), F.col("r.rid").alias("rid")), "classes")
    buckets = classes.select("node", "sig").mapInArrow(_bucket, "key long, node binary")
    several = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    shared = buckets.join(several, "key").join(classes.select("node", "sig"), "node").select("key", "node", "sig", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("pos"))
    shared = materialize(shared, "buckets")
    # The texts of the classes that share a bucket with another class, once for all rounds.
    wanted = shared.select("node").distinct().join(classes.select("node", "doc_id", "rid"), "node")
    keyed = rows.select(F.col("doc_id").alias("id"), F.col("rid").alias("key"), "text")
    found = keyed.join(wanted, (F.col("key") == F.col("rid")) & F.col("id").eqNullSafe(F.col("doc_id"))).select("node", "text")
    texts = materialize(found.groupBy("node").agg(F.first("text").alias("text")), "texts")
    linker = _Linker(texts, width, percent, tile)
    left = linker.settle(shared, hub_rounds, 0)
    if left is not None:
        # Crowded buckets of sets that are alike but not linked: split by their rarest shingles.
        rest = texts.join(left.select("node").distinct(), "node")
        left = linker.settle(materialize(_rare_buckets(rest, width, percent).join(classes.select("node", "sig"), "node"), "rare"), min(3, hub_rounds), hub_rounds)
    if left is not None:
        linker.link(linker.rest(left))
    out = facts.select("doc_id", "rid", "n_shingles", "node")
    if linker.labels is None:
        return out.withColumn("label", F.col("node"))
    return out.join(linker.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The contract's rows: doc_id, n_shingles, component_id, kept."""
    found = components(docs, **options)
    ids = found.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least")).select(F.col("label").alias("l"), "least")
    joined = found.join(ids, F.col("label") == F.col("l"), "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Texts without words all stay."""
    found = components(docs, **options).where(F.col("label").isNotNull())
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("r"))
    keepers = first.select(F.col("r.doc_id").alias("id"), F.col("r.rid").alias("key")).distinct()
    wordy = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    rows = boxed(docs, F.col("doc_id").alias("_id"), row_key(F.col("doc_id"), F.col("text")).alias("_rid"), wordy.alias("_wordy"))
    kept = rows.where("_wordy").join(keepers, (F.col("_rid") == F.col("key")) & F.col("_id").eqNullSafe(F.col("id")))
    kept = kept.groupBy("_id", "_rid").agg(F.first("_row").alias("_row")).select("_row.*")
    return kept.unionByName(rows.where("not _wordy").select("_row.*"))


ORACLE = """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, sh FROM (
    SELECT r, array_to_string(ws[i : i + 4], ' ') AS sh FROM (SELECT r, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0))),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS x, b.r AS y, count(*) AS bo FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT x, y FROM o JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * bo >= 75 * (p.n + q.n - bo)),
b AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c(r, l) AS (SELECT r, r FROM w UNION SELECT b.y, c.l FROM c JOIN b ON b.x = c.r),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN w d ON d.r = c.l GROUP BY c.r)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, w.doc_id IS NOT DISTINCT FROM m.component_id AS kept
FROM w JOIN m USING (r) LEFT JOIN n USING (r)
"""
