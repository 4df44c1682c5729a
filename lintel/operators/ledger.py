"""Stored citations moved to where their evidence stands today: a priority match on three keys.

A stored anchor is looked for in today's evidence of its criterion by what it was (file, selector, text), else by its place if only one piece of
evidence stands there, else by its place and text. One that is found takes today's file and line; one that is not keeps its line and takes
its file's path in this checkout, if that is known. Nothing is laundered: what is not found stays as it was, and the contract refuses it.

Scale: evidence becomes an index with one row per key before the join, so that a page whose evidence stands on one line is one
row per key; anchors ask with three keys each, the best answer is a minimum.

Edge cases: null selectors and texts are empty ones; evidence that repeats a key counts once for it, the last for the first key, the first for
the third; anchors that repeat are moved alike; empty evidence moves files only; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators.contract import canonical_file, loose


def identity(path: Column, folder: str, root: str | None = None) -> Column:
    """What a path is in any checkout: snapshots by their published path, other files relative to the root."""
    plain = canonical_file(path, folder)
    return plain if root is None else F.when(F.startswith(plain, F.lit(root.rstrip("/") + "/")), F.substring(plain, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(plain)


def _keys(folder: str, root: str | None) -> Column:
    """(rank, key) of an anchor or a piece of evidence."""
    file, selector, text = identity(F.col("file"), folder, root), F.coalesce("selector", F.lit("")), loose(F.coalesce("snippet", F.lit("")))
    part = lambda *c: F.concat_ws("\n", "sc", *c)
    line = F.coalesce(F.col("line").cast("string"), F.lit(""))
    return F.array(*[F.struct(F.lit(n).alias("rank"), k.alias("key")) for n, k in enumerate((part(file, selector, text), part(file, line), part(file, line, text)), 1)])


def reanchored(stored: DataFrame, evidence: DataFrame, files: DataFrame, folder: str, root: str | None = None, here: str | None = None) -> DataFrame:
    """(at, file, line, how): where each stored anchor stands now.

    ``stored``: at, sc, file, line, selector, snippet; ``evidence``: the same with seq, its order, for at; ``files``: file, the audited files of
    this checkout. ``root`` is the stored checkout's folder, ``here`` this one's. how: exact, place, text, file or kept.
    """
    today = evidence.select(F.explode(_keys(folder, here)).alias("k"), "seq", "file", "line").select("k.*", "seq", F.struct("file", "line").alias("now"))
    index = today.groupBy("rank", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("now", "seq").alias("first"), F.max_by("now", "seq").alias("last"))
    # A place counts by itself only where one piece of evidence stands there.
    index = index.where((F.col("rank") != 2) | (F.col("n") == 1)).select("rank", "key", F.when(F.col("rank") == 1, F.col("last")).otherwise(F.col("first")).alias("now"))
    asked = stored.select("at", F.explode(_keys(folder, root)).alias("k")).select("at", "k.*")
    best = asked.join(index, ["rank", "key"]).groupBy("at").agg(F.min_by(F.struct("rank", "now"), "rank").alias("best"))
    known = files.select(identity(F.col("file"), folder, here).alias("known"), F.col("file").alias("current")).groupBy("known").agg(F.max("current").alias("current"))
    rows = stored.withColumn("known", identity(F.col("file"), folder, root)).join(best, "at", "left").join(known, "known", "left")
    found = F.col("best").isNotNull()
    file = F.when(found, F.col("best.now.file")).otherwise(F.coalesce("current", "file"))
    how = F.when(F.col("best.rank") == 1, "exact").when(F.col("best.rank") == 2, "place").when(F.col("best.rank") == 3, "text").when(F.col("current") != F.col("file"), "file").otherwise("kept")
    return rows.select("at", file.alias("file"), F.when(found, F.col("best.now.line")).otherwise(F.col("line")).alias("line"), how.alias("how"))
