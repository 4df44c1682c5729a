"""Which page a finding belongs to: a ranked match on several kinds of keys.

A finding names its page, most reliable first, by its own stamp, by a page snapshot (its file or the capture it came from),
by an address, by the name of a sample page, or by a source file that a page declares. Each kind is a
key; pages are indexed by (kind, key) with one row per key, findings that share a place look it up once, and the best kind wins. A
snapshot or an address that no page claims settles the matter: nothing weaker is tried.

Scale: places (distinct combinations of paths and names) are far fewer than findings; the index holds one row per
key however many pages share it, so a component that all pages declare is one row; a path has as many keys as
folders. Findings meet their place by :func:`lintel.operators.skew.lookup`, which no hot file holds up.

Edge cases: findings without any key, or with one that no page claims, stay with a null page; null and empty paths
and names are no keys; pages that repeat an address or a name are matched by the last of them, pages that share a
source by the first, both by ``position``; back slashes are slashes; empty tables give empty results or null pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators.graph import suffixes
from lintel.operators.skew import lookup
from lintel.plans.storage import materialize

#: Kinds of keys, most reliable first. ``tail`` and ``whole`` are the two ways in which one path can end in the other.
KINDS = ("snapshot", "address", "sample", "tail", "whole")
#: What a place is told by.
PLACE = ("file", "capture", "source_file", "sample_page")


def _slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def snapshot_id(path: Column, folder: str) -> Column:
    """The page id in a path ``.../<folder>/<id>/dom.html``; null for any other path."""
    parts = F.split(_slashes(path), "/")
    n, marker = F.size(parts), folder.split("/")
    at = F.slice(parts, F.greatest(n - 1 - len(marker), F.lit(1)), len(marker))
    there = (n >= len(marker) + 2) & (F.element_at(parts, -1) == "dom.html") & (at == F.array(*[F.lit(m) for m in marker]))
    name = F.try_element_at(parts, F.lit(-2))
    return F.when(there & name.rlike("^[A-Za-z0-9][A-Za-z0-9-]*$"), name)


def is_address(path: Column) -> Column:
    return F.coalesce(path.rlike("^(?i)https?://"), F.lit(False))


def _key(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def _keys(kind: str, keys: Column) -> Column:
    return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: _key(kind, k))


def page_index(pages: DataFrame) -> DataFrame:
    """(kind, key, page, shared): one row per key of the pages (id, name, url, position, sources)."""
    said = F.filter(F.transform(F.coalesce("sources", F.array().cast("array<string>")), _slashes), lambda s: s != "")
    keys = F.concat(
        F.array(_key("snapshot", F.col("id")), _key("address", F.col("url")), _key("sample", F.lower(F.nullif("name", F.lit(""))))),
        _keys("tail", said),
        _keys("whole", F.flatten(F.transform(said, suffixes))),
    )
    rows = pages.select("id", "position", F.explode(keys).alias("k")).where(F.col("k.key").isNotNull()).select("k.*", "id", "position")
    last = F.col("kind").isin("address", "sample")
    of_key = rows.groupBy("kind", "key").agg(F.min_by("id", "position").alias("first"), F.max_by("id", "position").alias("last"), F.min("position").alias("from"), F.max("position").alias("to"), F.count_distinct("id").alias("n"))
    return of_key.select("kind", "key", F.when(last, F.col("last")).otherwise(F.col("first")).alias("page"), F.when(last, F.col("to")).otherwise(F.col("from")).alias("position"), (F.col("n") > 1).alias("shared"))


def place_keys(folder: str) -> Column:
    """The keys of a place, those of a weaker kind left out where a stronger one settles the matter."""
    snapshot = F.coalesce(snapshot_id(F.col("file"), folder), snapshot_id(F.col("capture"), folder))
    source = F.nullif(_slashes(F.coalesce("source_file", "file")), F.lit(""))
    by_source = F.when(source.isNotNull(), F.concat(_keys("tail", suffixes(source)), F.array(_key("whole", source)))).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    named = F.array(_key("sample", F.lower(F.nullif("sample_page", F.lit("")))))
    return F.when(snapshot.isNotNull(), F.array(_key("snapshot", snapshot))).when(is_address(F.col("file")), F.array(_key("address", F.col("file")))).otherwise(F.concat(named, by_source))


def attribute_pages(findings: DataFrame, pages: DataFrame, folder: str) -> DataFrame:
    """``findings`` with the page they belong to in ``page``, how it was found in ``page_kind``, and ``approximate``.

    ``findings``: page (their own stamp, or null), file, capture, source_file, sample_page, and any other columns;
    ``pages``: id, name, url, position (their order), sources (paths). ``folder`` is where page snapshots stand. A page is
    approximate when only a source file tells it and several pages declare that file.
    """
    text = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in PLACE]
    rows = materialize(findings.withColumn("_place", F.sha2(F.concat_ws("\n", *[F.concat(F.length(t).cast("string"), t) for t in text]), 256)), "findings")
    places = rows.select("_place", *PLACE).dropDuplicates(["_place"])
    named = F.coalesce(F.col("sample_page") != "", F.lit(False))
    asked = places.select("_place", named.alias("_named"), F.explode(place_keys(folder)).alias("k")).where(F.col("k.key").isNotNull())
    hits = asked.select("_place", "_named", "k.*").join(page_index(pages), ["kind", "key"])
    source = F.col("kind").isin("tail", "whole")
    rank = F.least(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(4))
    shared = (F.count_distinct(F.when(source, F.col("page"))) > 1) | F.bool_or(source & F.col("shared"))
    best = F.min(F.struct(rank.alias("rank"), "position", "page"))
    found = hits.groupBy("_place").agg(best.alias("_best"), (shared & ~F.bool_or("_named")).alias("_approximate"))
    found = found.select("_place", F.col("_best.page").alias("_page"), F.col("_best.rank").alias("_rank"), "_approximate")
    out = lookup(rows, materialize(found, "places"), "_place")
    kind = F.when(F.col("page").isNotNull(), "stamp")
    for n, name in enumerate((*KINDS[:3], "source"), 1):
        kind = kind.when(F.col("_rank") == n, name)
    page = F.coalesce("page", "_page")
    kept = [c for c in findings.columns if c != "page"]
    return out.select(*kept, page.alias("page"), kind.alias("page_kind"), (page.isNotNull() & F.coalesce("_approximate", F.lit(False))).alias("approximate"))


def unattributed(findings: DataFrame) -> DataFrame:
    """Findings that no page claims: reported, never dropped."""
    return findings.where(F.col("page").isNull())
