"""Sharding by balanced label propagation; the law that holds is ``bytes``.

Links join documents with equal texts. Linked documents start at hashed shards and move, by
iterated Spark joins, to the shard that holds most of their group and has room for the rest (to the one that holds
most where none has), small cells first, as far as the target's capacity (an even share of all bytes) allows; a queue's prefix sums
count against the whole of it, however many cells there are. What moves is a cell: the members of one group
that started in one shard, so a group with a third of all rows stays spread over its cells.
Cells that leave a shard over its share are dissolved. Unlinked documents then fill the shards to the same level: from large to small (bands by powers
of two), each band is laid along the shards' gaps by prefix sums, and later, smaller bands
correct what larger ones left uneven. Bands of fewer than ``few`` documents a shard are dealt one by one
to the emptiest shard.

Scale: texts are reduced to size, CRC and a 128-bit hash in the first scan. Group votes are
partial aggregates; prefix sums and slots have two levels (per salt, then inside a salt), and the
number of salts follows from the rows (``salt_rows`` rows to each). The driver holds only numbers per
shard and per band; what is kept per (band, salt) or (shard, salt) is a small table.

Shards depend on the rows alone: a document's hash is that of its id, text and, among equal rows, its
number, so reruns agree however the rows are stored.

Edge cases: a null text has no bytes and equals the empty text; null ids and repeated rows are
documents like others; ties in size and bytes go by hash; an empty table gives an empty result; a document
larger than an even share (a very long text) fills a shard alone, and a group larger than a share is
spread over several; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import two_hashes
from lintel.plans.storage import discard, materialize

SALTS = 64


def salts_for(rows: int, salt_rows: int) -> int:
    """A power of two: enough that a salt of all rows holds about ``salt_rows``, SALTS at least."""
    return max(SALTS, 1 << max(0, math.ceil(math.log2(max(1, rows / salt_rows)))))


def _facts(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    g1, g2 = two_hashes(text)
    facts = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        g1.alias("g1"),
        g2.alias("g2"),
    )
    # Equal rows are told apart by a number; any numbering of them gives the same result.
    number = F.row_number().over(Window.partitionBy("doc_id", "g1", "g2").orderBy("size"))
    facts = facts.withColumn("h", F.xxhash64(F.lit(15485863), F.col("doc_id"), F.col("g1"), F.col("g2"), number))
    return materialize(facts.withColumn("start", F.pmod("h", F.lit(shards)).cast("int")), "facts")


def _room(loads: dict[int, int], cap: float, shards: int) -> list[int]:
    return [max(0, int(cap) - loads.get(s, 0)) for s in range(shards)]


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), at + 1)


def _queued(rows: DataFrame, goal: Column, salts: int, *order: Column | str) -> DataFrame:
    """Adds ``asked``: the bytes of a row and of all before it in the queue of its ``goal``, small cells first; null without a goal.

    A queue is summed in two levels, per band of sizes (powers of two) and salt, then inside them, so all of it counts against one room.
    """
    waits = goal.isNotNull()
    keyed = rows.withColumn("_goal", goal).withColumn("_band", F.length(F.bin("bytes"))).withColumn("_salt", F.when(waits, F.pmod("g1", F.lit(salts))).otherwise(F.pmod("g2", F.lit(997))))
    key = ["_goal", "_band", "_salt"]
    sums = keyed.where("_goal is not null").groupBy(*key).agg(F.sum("bytes").alias("sum"))
    before = Window.partitionBy("_goal").orderBy("_band", "_salt").rowsBetween(Window.unboundedPreceding, -1)  # bands x salts rows a goal
    sums = sums.select(*key, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*key).orderBy("bytes", *order, "g1", "g2", "start").rowsBetween(Window.unboundedPreceding, 0)
    return keyed.withColumn("inner", F.sum("bytes").over(inside)).join(sums, key, "left").withColumn("asked", F.col("inner") + F.col("offset")).drop(*key, "inner", "offset")


def propagate(cells: DataFrame, shards: int, cap: float, rounds: int, queue: int = 20_000) -> DataFrame:
    """Move cells (g1, g2, start, n, bytes) towards their group's main shard; adds ``shard``. ``queue`` is how many cells are put in order together."""
    state, salts = materialize(cells.withColumn("shard", F.col("start")).withColumn("moved", F.lit(0)), "labels"), 1
    for _ in range(rounds):
        facts = state.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("cells")).collect()  # one row per shard
        loads = {r["shard"]: r["bytes"] for r in facts}
        salts = max(1, sum(r["cells"] for r in facts) // queue)
        room = _room(loads, cap, shards)
        votes = state.groupBy("g1", "g2", "shard").agg(F.sum("bytes").alias("bytes"))
        rest = F.sum("bytes").over(Window.partitionBy("g1", "g2")) - F.col("bytes")  # at most `shards` rows a group
        votes = votes.withColumn("fits", rest <= _pick(room, F.col("shard")))  # a shard that has room for the rest of the group comes first
        best = F.max(F.struct("fits", "bytes", F.xxhash64("g1", "shard").alias("tie"), "shard"))
        wanted = votes.groupBy("g1", "g2").agg(best.alias("b")).select("g1", "g2", F.col("b.shard").alias("goal"), F.col("b.bytes").alias("pull"))
        joined = state.join(wanted, ["g1", "g2"])
        asked = _queued(joined, F.when(F.col("shard") != F.col("goal"), F.col("goal")), salts, F.desc("pull"))  # a cell that does not fit holds up no smaller one
        take = F.coalesce(F.col("asked") <= _pick(room, F.col("goal")), F.lit(False))
        after = asked.select("g1", "g2", "start", "n", "bytes", F.when(take, F.col("goal")).otherwise(F.col("shard")).alias("shard"), F.when(take, 1).otherwise(0).alias("moved"))
        older, state = state, materialize(after, "labels")
        discard(older)
        if not state.agg(F.sum("moved")).first()[0]:
            break
    # Cells over a shard's capacity, largest first, give up their place; their documents fill gaps one by one.
    loads = {r["shard"]: r["bytes"] for r in state.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    over = [s for s, n in loads.items() if n > cap]
    held = _queued(state, F.when(F.col("shard").isin(over), F.col("shard")), salts)
    return held.withColumn("shard", F.when(F.coalesce(F.col("asked") <= int(cap), F.lit(True)), F.col("shard"))).drop("asked")


def _gaps(loads: list[int], amount: int) -> list[int]:
    """How much of ``amount`` each shard gets so that the lowest rise to one level."""
    order = sorted(range(len(loads)), key=lambda s: (loads[s], s))
    level, used = 0.0, 0
    total = amount
    for i, s in enumerate(order):
        used = i + 1
        total += loads[s]
        level = total / used
        if i + 1 == len(order) or loads[order[i + 1]] >= level:
            break
    gaps = [0] * len(loads)
    for s in order[:used]:
        gaps[s] = max(0, int(level) - loads[s])
    gaps[order[0]] += amount - sum(gaps)
    return gaps


def _cuts(gaps: list[int]) -> tuple[list[int], list[int]]:
    """Start positions along the band and the shard from each on."""
    at, starts, owners = 0, [], []
    for s in sorted(range(len(gaps)), key=lambda s: (-gaps[s], s)):
        if gaps[s] > 0:
            starts.append(at)
            owners.append(s)
            at += gaps[s]
    return starts, owners


def _owner(pos: Column, starts: list[int], owners: list[int]) -> Column:
    bounds = F.array(*[F.lit(int(v)).cast("long") for v in starts])
    return F.element_at(F.array(*[F.lit(s) for s in owners]), F.size(F.filter(bounds, lambda b: b <= pos)))


def shard(docs: DataFrame, shards: int = 40, rounds: int = 6, few: int = 64, salt_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    facts = _facts(docs.select("doc_id", "text"), shards)
    salts = salts_for(facts.count(), salt_rows)
    group = ["g1", "g2"]
    cells = facts.groupBy(*group, "start").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    cells = materialize(cells.withColumn("members", F.sum("n").over(Window.partitionBy(*group))), "cells")  # at most `shards` rows a group
    total = cells.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    state = propagate(cells.where("members > 1").select(*group, "start", "n", "bytes"), shards, total / shards, rounds)
    band = F.when(F.col("fixed").isNull(), F.length(F.bin("size")))
    rows = facts.join(state.select(*group, "start", F.col("shard").alias("fixed")), [*group, "start"], "left")
    rows = rows.select("doc_id", "size", "text_crc32", "fixed", band.alias("band"), F.pmod("h", F.lit(salts)).cast("int").alias("salt"), "h")
    inside = Window.partitionBy("band", "salt", F.when(F.col("band").isNull(), F.pmod("h", F.lit(4096)))).orderBy("size", "h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = materialize(rows.where("band is not null").groupBy("band", "salt").agg(F.sum("size").alias("bytes")), "sums")
    lower = Window.partitionBy("band").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("band", "salt", F.coalesce(F.sum("bytes").over(lower), F.lit(0)).alias("offset"))  # at most 32 bands x salts rows
    rows = rows.join(offsets, ["band", "salt"], "left")
    rows = materialize(rows.withColumn("pos", F.col("inner") + F.col("offset")).drop("inner", "offset"), "rows")
    amount = {r["band"]: r["bytes"] for r in sums.groupBy("band").agg(F.sum("bytes").alias("bytes")).collect()}  # at most 32 bands
    loads = [0] * shards
    for r in rows.where("fixed is not null").groupBy("fixed").agg(F.sum("size").alias("bytes")).collect():
        loads[r["fixed"]] = r["bytes"]
    chosen: list[tuple[int, Column]] = []
    dealt: list[tuple[int, int]] = []
    spark = docs.sparkSession
    for b in sorted(amount, reverse=True):
        if amount[b] < few * shards << (b - 1):  # sizes of the band are at least 2^(b - 1): fewer than `few` documents a shard
            for r in rows.where(F.col("band") == b).select("h", "size").orderBy(F.desc("size"), "h").collect():
                s = min(range(shards), key=lambda s: (loads[s], s))
                loads[s] += r["size"]
                dealt.append((r["h"], s))
            continue
        starts, owners = _cuts(_gaps(loads, amount[b]))
        chosen.append((b, _owner(F.col("pos"), starts, owners)))
        for r in rows.where(F.col("band") == b).groupBy(chosen[-1][1].alias("s")).agg(F.sum("size").alias("bytes")).collect():
            loads[r["s"]] += r["bytes"]
    filled = reduce(lambda rest, x: F.when(F.col("band") == x[0], x[1]).otherwise(rest), chosen, F.lit(None).cast("int"))
    # At most `few` documents a shard and band were dealt one by one.
    single = F.broadcast(spark.createDataFrame(dealt, "h long, single int"))
    placed = rows.join(single, "h", "left").select("doc_id", "size", "text_crc32", F.coalesce("fixed", "single", filled).alias("shard"), "salt", "h")
    counts = placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("h", "doc_id", "size"))
    slots = placed.withColumn("k", number).join(counts, ["shard", "salt"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
