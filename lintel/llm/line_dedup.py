"""Line dedup: drop lines that many documents share, except in one of them.

Lines are exploded, normalised and hashed (128 bits); distinct documents are counted per hash
with partial aggregation; the lines over the threshold lose every occurrence but those of the
largest doc_id; texts are reassembled by position. Only hashes and positions are shuffled for
the count and the lookup; texts move once, keyed by row.

Skew: lines found very often ("hot") are at most lines / hot_share in number, so their keepers
are broadcast under that proven bound; the others join by hash. A hot line therefore never
meets in one task. A line that stands very often but in too few documents (one huge document, rows without
id) finds no partner in that join, whose sides are shuffled tables that adaptive execution splits.

Edge cases: a null or empty text is one empty line (kept, as its key is short); rows with a
null id are not counted as documents, and lose a dropped line; rows that repeat an id count as
one document and all keep a line whose largest id they carry; an empty table gives an empty
result; a very long text is split like any other; other columns travel packed, so that none can clash, and
pass through untouched, but n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import LOWER, SPACES, UPPER, ascii_lower, boxed, row_key, two_hashes, with_text
from lintel.plans.storage import materialize


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, rid, pos, h1, h2) of the lines long enough to be compared."""
    exploded = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    stripped = exploded.select("doc_id", "rid", "pos", F.trim(F.col("line"), F.lit(SPACES)).alias("line")).where(F.char_length("line") >= min_chars)
    h1, h2 = two_hashes(F.col("key"))
    return stripped.select("doc_id", "rid", "pos", ascii_lower(F.col("line")).alias("key")).select("doc_id", "rid", "pos", h1.alias("h1"), h2.alias("h2"))


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int, hot_share: int) -> DataFrame:
    """(doc_id, rid, drops): the line positions that each row loses; rows without any are absent."""
    lines = keyed_lines(docs, min_chars)
    by_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    common = by_doc.groupBy("h1", "h2").agg(F.count("doc_id").alias("docs"), F.sum("n").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    common = materialize(common, "common-lines")
    held = common.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot_from = max(1000, held // hot_share)
    hot, cold = common.where(F.col("n") > hot_from), common.where(F.col("n") <= hot_from)
    # Each hot line holds more than 1 / hot_share of the common lines, so there are fewer than hot_share of them.
    marked = lines.join(F.broadcast(hot.select("h1", "h2", F.col("keeper").alias("hot_keeper"))), ["h1", "h2"], "left")
    hot_drops = marked.where(F.col("hot_keeper").isNotNull()).select("doc_id", "rid", "pos", F.col("hot_keeper").alias("keeper"))
    cold_drops = marked.where(F.col("hot_keeper").isNull()).join(cold.select("h1", "h2", "keeper"), ["h1", "h2"]).select("doc_id", "rid", "pos", "keeper")
    drops = hot_drops.unionByName(cold_drops).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return drops.groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("drops"))


def _kept(text: Column, drops: Column) -> Column:
    """The lines left, joined; the split is bound once per row and positions are looked up directly."""
    bound = F.array(_lines(text))
    kept = F.transform(bound, lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), drops), lambda i: ls[i]))
    return F.when(drops.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept[0], "\n"))


def cleaned(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, hot_share: int = 1000) -> DataFrame:
    """Rows of ``docs`` packed in ``_row`` with kept_text, n_lines and n_dropped."""
    drops = dropped_positions(docs, min_chars, min_docs, hot_share)
    rows = boxed(docs, F.col("doc_id").alias("_id"), row_key(F.col("doc_id"), F.col("text")).alias("_rid"))
    joined = rows.join(drops, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_rid") == F.col("rid")), "left")
    text = F.col("_row.text")
    return joined.select(
        "_row",
        _kept(text, F.col("drops")).alias("kept_text"),
        F.size(_lines(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("drops")), F.lit(0)).cast("long").alias("_n"),
        F.col("drops").isNull().alias("_whole"),
    ).select("_row", "kept_text", "n_lines", F.when(F.col("_whole"), 0).otherwise(F.col("_n")).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with their remaining lines; same columns, a text that lost no line is unchanged (null stays null)."""
    out = cleaned(docs, **options)
    text = F.when(F.col("n_dropped") == 0, F.col("_row.text")).otherwise(F.col("kept_text"))
    return out.select(*with_text(docs.columns, text))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """The contract's rows: doc_id, n_lines, n_dropped, kept_sha256."""
    out = cleaned(docs.select("doc_id", "text"), **options)
    return out.select("_row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_STRIP}), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
