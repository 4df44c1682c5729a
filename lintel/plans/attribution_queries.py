"""Named queries of page attribution: pages of the ``pages`` table, findings made from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators import attribution
from lintel.plans.registry import query
from lintel.plans.storage import table

_FOLDER = ".shots/pages"
#: Thirty names and source files are shared by pages whose ids agree modulo 30 (40 for the second source); every third page declares no source.
_SCOPE = (
    "p AS (SELECT 'p' || page_id AS id, 'Page ' || page_id % 30 AS name, url, CAST(page_id AS BIGINT) AS position, "
    "CASE WHEN page_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['app/route' || page_id % 30 || '/page.tsx', 'lib/part' || page_id % 40 || '.tsx'] END AS sources FROM pages), n AS (SELECT count(*) AS n FROM pages)"
)
_PLACES = (
    "f AS (SELECT event_id, k, n, u.url, CASE WHEN k = 0 THEN 'p' || user_id % (2 * n) END AS page, "
    "CASE k WHEN 1 THEN 'repo/.shots/pages/p' || user_id % (2 * n) || '/dom.html' WHEN 3 THEN coalesce(u.url, 'https://elsewhere.example/' || user_id) WHEN 5 THEN 'C:\\work\\app\\route' || user_id % 40 || '\\page.tsx' "
    "WHEN 6 THEN CASE WHEN user_id % 2 = 0 THEN 'page.tsx' ELSE 'part' || user_id % 50 || '.tsx' END WHEN 7 THEN 'lib/unknown' || user_id || '.tsx' WHEN 0 THEN 'lib/part' || user_id % 40 || '.tsx' ELSE 'x' END AS file, "
    "CASE WHEN k = 2 THEN '.shots/pages/p' || user_id % n || '/dom.html' END AS capture, CASE WHEN k = 4 AND user_id % 3 = 0 THEN '/root/work/lib/part' || user_id % 40 || '.tsx' END AS source_file, "
    "CASE WHEN k = 4 THEN 'PAGE ' || user_id % 35 END AS sample_page "
    "FROM (SELECT event_id, user_id, event_id % 8 AS k, n FROM events, n) e LEFT JOIN (SELECT page_id, url FROM pages) u ON k = 3 AND u.page_id = e.user_id % (2 * n))"
)
_MATCHED = (
    "s AS (SELECT id, position, unnest(sources) AS s FROM p), q AS (SELECT DISTINCT coalesce(source_file, file) AS src FROM f), "
    "m AS (SELECT src, min_by(id, position) AS page, count(DISTINCT id) AS pages FROM (SELECT src, replace(src, '\\', '/') AS x FROM q) JOIN s ON x = s OR x LIKE '%/' || s OR s LIKE '%/' || x GROUP BY src), "
    "a AS (SELECT f.*, CASE WHEN f.page IS NOT NULL THEN f.page WHEN k = 1 THEN b.id WHEN k = 2 THEN c.id WHEN k = 3 THEN d.id ELSE coalesce(g.id, m.page) END AS found, "
    "CASE WHEN f.page IS NOT NULL THEN 'stamp' WHEN b.id IS NOT NULL OR c.id IS NOT NULL THEN 'snapshot' WHEN k = 3 AND d.id IS NOT NULL THEN 'address' WHEN k > 3 AND g.id IS NOT NULL THEN 'sample' WHEN k > 3 AND m.page IS NOT NULL THEN 'source' END AS page_kind, "
    "k IN (0, 4, 5, 6, 7) AND sample_page IS NULL AND coalesce(m.pages, 0) > 1 AS several FROM f "
    "LEFT JOIN p b ON k = 1 AND f.file = 'repo/.shots/pages/' || b.id || '/dom.html' LEFT JOIN p c ON k = 2 AND f.capture = '.shots/pages/' || c.id || '/dom.html' LEFT JOIN (SELECT url, max_by(id, position) AS id FROM p GROUP BY url) d ON d.url = f.file "
    "LEFT JOIN (SELECT lower(name) AS name, max_by(id, position) AS id FROM p GROUP BY 1) g ON g.name = lower(f.sample_page) LEFT JOIN m ON m.src = coalesce(f.source_file, f.file)), "
    "r AS (SELECT event_id, found AS page, page_kind, found IS NOT NULL AND several AS approximate FROM a)"
)
_WITH = f"WITH {_SCOPE}, {_PLACES}, {_MATCHED}"


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    declared = F.array(F.concat(F.lit("app/route"), (i % 30).cast("string"), F.lit("/page.tsx")), F.concat(F.lit("lib/part"), (i % 40).cast("string"), F.lit(".tsx")))
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), i.cast("string")).alias("id"), F.concat(F.lit("Page "), (i % 30).cast("string")).alias("name"), "url", i.cast("long").alias("position"), F.when(i % 3 != 0, declared).alias("sources")
    )


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    n = pages.count()
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 8).alias("k")).withColumn("u", F.col("user_id") % (2 * n))
    e = e.join(pages.select(F.col("page_id").alias("u"), "url"), "u", "left")
    user, u = F.col("user_id"), F.col("u").cast("string")
    part = lambda m: (user % m).cast("string")
    k = lambda v: F.col("k") == v
    file = (
        F.when(k(1), F.concat(F.lit("repo/.shots/pages/p"), u, F.lit("/dom.html")))
        .when(k(3), F.coalesce("url", F.concat(F.lit("https://elsewhere.example/"), user.cast("string"))))
        .when(k(5), F.concat(F.lit("C:\\work\\app\\route"), part(40), F.lit("\\page.tsx")))
        .when(k(6), F.when(user % 2 == 0, "page.tsx").otherwise(F.concat(F.lit("part"), part(50), F.lit(".tsx"))))
        .when(k(7), F.concat(F.lit("lib/unknown"), user.cast("string"), F.lit(".tsx")))
        .when(k(0), F.concat(F.lit("lib/part"), part(40), F.lit(".tsx")))
        .otherwise("x")
    )
    return e.select(
        "event_id", F.when(k(0), F.concat(F.lit("p"), u)).alias("page"), file.alias("file"), F.when(k(2), F.concat(F.lit(".shots/pages/p"), part(n), F.lit("/dom.html"))).alias("capture"),
        F.when(k(4) & (user % 3 == 0), F.concat(F.lit("/root/work/lib/part"), part(40), F.lit(".tsx"))).alias("source_file"), F.when(k(4), F.concat(F.lit("PAGE "), part(35))).alias("sample_page"),
    )


@query(f"{_WITH} SELECT event_id, page, page_kind, approximate FROM r")
def pages_attributed(spark, sf_dir):
    """Every finding with the page it belongs to."""
    found = attribution.attribute_pages(_places(spark, sf_dir), _scope(spark, sf_dir), _FOLDER)
    return found.select("event_id", "page", "page_kind", "approximate")


@query(f"{_WITH} SELECT page, count(*) AS occurrences, count(*) FILTER (approximate) AS approximate FROM r GROUP BY page")
def pages_attributed_counts(spark, sf_dir):
    """Occurrences per page, those that no page claims among them (null)."""
    found = attribution.attribute_pages(_places(spark, sf_dir), _scope(spark, sf_dir), _FOLDER)
    return found.groupBy("page").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if("approximate").alias("approximate"))
