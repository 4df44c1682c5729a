"""Filter interaction audit: what each quality filter removes under every order of application.

Each document fails a subset of the filters, a mask of bits. A table of masks by orders, made once, holds the
step of each order at which a document with that mask is removed first. Tasks index it for a batch of
masks, count (part, order, step, label) cells with ``np.bincount``, and hand on one partial array per part and
order, which Spark sums.

Scale: texts are read once and never shuffled; what moves are ids, 32-byte digests and masks. Identical texts meet as
digests with the smallest id of each. Digests and ids that very many rows share are looked up by a bounded
broadcast (:func:`lintel.operators.skew.lookup`). A task holds the arrays of at most ``parts_held`` parts (25 kB each)
and then hands them on.

Edge cases: a null text is empty, and fails A alone of the first four; a null source is the part '' (as an empty one); a null doc_id is
smaller than none, so it neither fails E nor makes others fail, and has no labels; rows that repeat an id and a
text do not fail E through each other (the id is not smaller), but count as rows each; an id labelled several times is good (toxic) if any of
its labels says so; unlabelled rows are neither; texts of any length are split in windows; empty tables give
no rows; columns besides doc_id, text and source are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.operators.skew import lookup
from lintel.plans.storage import materialize, small_batches

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(0x41, 0x5B))
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#$%&*|"
_WINDOW = 1 << 20
#: What a partial array counts per step: rows removed, good ones, toxic ones.
_KINDS = ("removed", "good", "toxic")
STEPS = len(FILTERS)


def first_failures() -> np.ndarray:
    """[mask, order]: the step (from 0) whose filter is the first that the mask fails; STEPS where it fails none."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for at, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            fails = (np.arange(1 << STEPS) >> FILTERS.index(order[step])) & 1 == 1
            table[fails, at] = step
    return table


def _windows(text: bytes) -> Iterator[bytes]:
    """Consecutive parts of about a megabyte, cut at white space only."""
    at = 0
    while len(text) - at > _WINDOW:
        end = at + _WINDOW
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails by itself."""
    words, distinct = 0, set()
    for window in _windows(text):
        found = window.split()
        words += len(found)
        distinct.update(found)
    points = len(text.translate(None, _CONTINUED))
    upper = len(text) - len(text.translate(None, _UPPER))
    fails = (words < 50, 100 * len(distinct) < 65 * words, 100 * upper > 5 * points, len(text.translate(None, _SYMBOLS)) < len(text))
    return sum(1 << i for i, f in enumerate(fails) if f)


def _mask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, masks = [], []
        for value in batch.column("text"):
            text = value.as_py()
            digests.append(hashlib.sha256(text).digest())
            masks.append(text_mask(text))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], ["doc_id", "part", "digest", "mask"])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row; bit i of the mask is set where the row fails filter i. A written table."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = materialize(rows.mapInArrow(_mask_rows, f"doc_id {kind}, part string, digest binary, mask int"), "own-masks")
    copies = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    copies = materialize(copies, "copies")
    seen = lookup(own, copies.select("digest", "first"), "digest", counts=copies.select("digest", "n"))
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return materialize(seen.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask")), "masks")


def labelled(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``masks`` with good and toxic (0 or 1)."""
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    out = lookup(masks, one, "doc_id")
    return out.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


_TOTALS = ["n", *[f"fails_{f}" for f in FILTERS], *[f"unique_{f}" for f in FILTERS]]
_CELLS = [f"{k}_{s}" for k in _KINDS for s in range(1, STEPS + 1)]
_PARTIAL = "part string, order_no int, " + ", ".join(f"{c} long" for c in [*_TOTALS, *_CELLS])


def _partial(part: str, by_step: np.ndarray, by_mask: np.ndarray) -> list[pa.Array]:
    """One part's columns: 120 rows with the totals (the same in each) and the removals of every step."""
    masks = np.arange(1 << STEPS)
    fails = [by_mask[(masks >> i) & 1 == 1].sum() for i in range(STEPS)]
    totals = [by_mask.sum(), *fails, *[by_mask[1 << i] for i in range(STEPS)]]
    rows = len(ORDERS)
    columns = [pa.array([part] * rows, pa.string()), pa.array(np.arange(rows, dtype=np.int32))]
    columns += [pa.array(np.full(rows, t, np.int64)) for t in totals]
    # by_step: [order, step, good, toxic]
    kinds = (by_step.sum(axis=(2, 3)), by_step[:, :, 1].sum(axis=2), by_step[:, :, :, 1].sum(axis=2))
    return columns + [pa.array(np.ascontiguousarray(k[:, s])) for k in kinds for s in range(STEPS)]


def _count(parts_held: int, slice_rows: int = 1000):
    table, orders, names = first_failures(), len(ORDERS), ["part", "order_no", *_TOTALS, *_CELLS]
    # A row's cell within its part: (order, step, good, toxic), with one step more for what stays.
    cells = orders * (STEPS + 1) * 4

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for part, (by_step, by_mask) in held.items():
            yield pa.RecordBatch.from_arrays(_partial(part, by_step, by_mask), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                parts = batch.column("part").dictionary_encode()
                where, mask = parts.indices.to_numpy(), batch.column("mask").to_numpy()
                label = 2 * batch.column("good").to_numpy() + batch.column("toxic").to_numpy()
                step = (np.arange(orders) * (STEPS + 1) + table[mask]) * 4 + label[:, None]
                n = len(parts.dictionary)
                removed = np.bincount((where[:, None].astype(np.int64) * cells + step).ravel(), minlength=n * cells)
                removed = removed.reshape(n, orders, STEPS + 1, 2, 2)[:, :, :STEPS]
                masks = np.bincount(where.astype(np.int64) * len(table) + mask, minlength=n * len(table)).reshape(n, len(table))
                for i, part in enumerate(parts.dictionary.to_pylist()):
                    if part in held:
                        held[part][0] += removed[i]
                        held[part][1] += masks[i]
                    else:
                        held[part] = [removed[i].copy(), masks[i].copy()]
                if len(held) > parts_held:
                    yield from emit(held)
                    held = {}
        yield from emit(held)

    return run


def interactions(rows: DataFrame, parts_held: int = 1000) -> DataFrame:
    """The contract's rows from (part, mask, good, toxic) rows."""
    partial = rows.mapInArrow(_count(parts_held), _PARTIAL)
    summed = partial.groupBy("part", "order_no").agg(*[F.sum(c).alias(c) for c in [*_TOTALS, *_CELLS]])
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("order_no") + 1)
    steps = [
        F.struct(F.lit(s).alias("step"), *[F.col(f"{k}_{s}").alias(k) for k in _KINDS], sum(F.col(f"removed_{i}") for i in range(1, s + 1)).alias("gone"))
        for s in range(1, STEPS + 1)
    ]
    long = summed.select("part", order.alias("filter_order"), "n", F.array(*[F.col(f"fails_{f}") for f in FILTERS]).alias("fails"), F.array(*[F.col(f"unique_{f}") for f in FILTERS]).alias("unique"), F.explode(F.array(*steps)).alias("s"))
    letter = F.substring("filter_order", F.col("s.step"), F.lit(1))
    at = F.instr(F.lit(FILTERS), letter)
    long = long.select("part", "filter_order", F.col("s.step").alias("step"), letter.alias("_filter"), "s.removed", "s.good", "s.toxic", "s.gone", "n", F.element_at("fails", at).alias("_fails"), F.element_at("unique", at).alias("unique_fails"))
    return long.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        (F.col("n") - F.col("gone")).alias("kept"),
        "removed",
        (F.col("_fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("removed").over(Window.partitionBy("part", "_filter")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, parts_held: int = 1000) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(labelled(failures(docs), labels), parts_held)


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
c AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        [len({_WORDS}) < 50,
         100 * len(list_distinct({_WORDS})) < 65 * len({_WORDS}),
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
         regexp_matches(t, '[#$%&*|]'),
         coalesce(first < d.doc_id, FALSE)] AS fails
      FROM d JOIN c USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, o, i AS step, substr(o, i, 1) AS filter, n, good, toxic, fails,
        fails[ascii(substr(o, i, 1)) - 64] AS hit,
        list_contains([fails[ascii(substr(o, j, 1)) - 64] FOR j IN range(1, i)], TRUE) AS gone
      FROM m, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
r AS (SELECT part, o, step, filter,
        sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN hit AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
      FROM s GROUP BY part, o, step, filter)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
