"""Named queries of evidence that relates the elements of a page: on ``pages``, and on pages made from the rows of ``supplier``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators import content
from lintel.plans.registry import query
from lintel.plans.storage import materialize, table
from lintel.sources.html import elements

_SLIM = ["last_ord", "tag", "attrs", "text"]
_CLEAN = "regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script>.*?</script>', '<script>', 'gs')"
_LINK = "'<a href=\"[^\"]*\">([^<]*)</a>', 1"
_K = "SELECT s_suppkey AS k FROM supplier"


def _label(n: int) -> str:
    return f"substr(trim(replace(x, '&amp;', '&')), 1, {n})"


def _made(spark: SparkSession, sf_dir: str, html: str, url: str = "''") -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    return rows.select(F.col("k").alias("page_id"), F.expr(url).alias("url"), F.expr(html).alias("html"))


@query(
    f"WITH c AS (SELECT page_id, {_CLEAN} AS h FROM pages), b AS (SELECT page_id, 'nav' AS tag, unnest(regexp_extract_all(h, '(?s)<nav>(.*?)</nav>', 1)) AS h FROM c UNION ALL "
    "SELECT page_id, 'footer', unnest(regexp_extract_all(h, '(?s)<footer>(.*?)</footer>', 1)) FROM c UNION ALL SELECT page_id, 'header', unnest(regexp_extract_all(h, '(?s)<header>(.*?)</header>', 1)) FROM c), "
    f"l AS (SELECT page_id, tag, regexp_extract_all(h, {_LINK}) AS l FROM b) "
    f"SELECT page_id, tag, coalesce(array_to_string(list_transform(l[1:20], x -> {_label(24)}), ' › '), '') AS link_order, CAST(len(l) AS BIGINT) AS links FROM l"
)
def pages_repeated_blocks(spark, sf_dir):
    """The links of every page's header, navigation and footer, in order."""
    rows = elements(table(spark, sf_dir, "pages"), _SLIM)
    return content.repeated_blocks(materialize(rows.where("tag in ('header', 'nav', 'footer', 'a')"), "blocks")).drop("ord")


@query(
    f"WITH l AS (SELECT page_id, regexp_extract_all({_CLEAN}, {_LINK}) AS l FROM pages) "
    f"SELECT page_id, array_to_string(list_transform(l[1:15], x -> 'a \"' || {_label(20)} || '\"'), ' → ') AS tab_order, CAST(len(l) AS BIGINT) AS stops FROM l WHERE len(l) > 0"
)
def pages_tab_orders(spark, sf_dir):
    """What Tab reaches on every page, in order."""
    return content.tab_orders(elements(table(spark, sf_dir, "pages"), _SLIM)).drop("ord")


_TABS = (
    "'<button disabled>x</button><input type=Hidden><a>n</a><p tabindex=-1>m</p><select hidden></select><i contenteditable=false>f</i>' || repeat('<a href=x>a rather long link text</a>', k % 18) || "
    "repeat('<input name=q>', k % 3) || repeat('<p tabindex=0 aria-label=lab></p>', k % 2) || repeat('<div contenteditable>e</div>', k % 4)"
)


@query(
    f"WITH l AS (SELECT k, list_transform(range(k % 18), x -> 'a \"a rather long link \"') || list_transform(range(k % 3), x -> 'input \"q\"') || list_transform(range(k % 2), x -> 'p[tabindex=0] \"lab\"') || list_transform(range(k % 4), x -> 'div \"e\"') AS l FROM ({_K})) "
    "SELECT k AS page_id, array_to_string(l[1:15], ' → ') AS tab_order, CAST(len(l) AS BIGINT) AS stops FROM l WHERE len(l) > 0"
)
def made_tab_orders(spark, sf_dir):
    return content.tab_orders(elements(_made(spark, sf_dir, _TABS), _SLIM)).drop("ord")


_BLOCKS = "'<header><a href=a>Home</a><nav>' || repeat('<p><a href=b>Entry number of the twenty</a></p>', k % 25) || '</nav><a href=c>Last</a></header><a href=d>out</a><footer>' || repeat('<div><a>f</a></div>', k % 4) || '</footer>'"


@query(
    f"WITH n AS (SELECT k, list_transform(range(k % 25), x -> 'Entry number of the twen') AS n FROM ({_K})), l AS (SELECT k, 'header' AS tag, ['Home'] || n || ['Last'] AS l FROM n UNION ALL SELECT k, 'nav', n FROM n UNION ALL "
    f"SELECT k, 'footer', list_transform(range(k % 4), x -> 'f') FROM ({_K})) SELECT k AS page_id, tag, coalesce(array_to_string(l[1:20], ' › '), '') AS link_order, CAST(len(l) AS BIGINT) AS links FROM l"
)
def made_repeated_blocks(spark, sf_dir):
    """Blocks in blocks, with and without links."""
    return content.repeated_blocks(materialize(elements(_made(spark, sf_dir, _BLOCKS), _SLIM), "blocks")).drop("ord")


_SHOWN = (
    "'<link rel=\"Stylesheet alternate\" href=s.css><link rel=icon href=i>' || repeat('<p role=tooltip>tip</p>', k % 3) || repeat('<div popover=auto>pop</div>', k % 2) || "
    "repeat('<button aria-controls=\" p1 p2\" aria-expanded=false>b</button><div id=p1>x</div>', k % 4) || repeat('<button aria-expanded=true>d</button>', k % 5) || "
    "repeat('<details><summary>s</summary>t</details>', k % 3) || '<a aria-describedby=nope>z</a>' || repeat('<i aria-describedby=t1 popovertarget=p1>i</i><b role=tooltip id=t1>u</b>', k % 2)"
)
#: Kind -> how many of it the page of row k holds.
_KINDS = {
    "tooltip": "k % 3 + k % 2", "popover": "k % 2", "trigger": "k % 4 + k % 2", "revealed": "CASE WHEN k % 4 > 0 THEN 1 ELSE 0 END", "disclosure": "k % 5", "details": "2 * (k % 3)",
    "stylesheet": "CASE WHEN k % 60 = 0 THEN 0 ELSE 1 END",
}


@query("WITH n AS (" + " UNION ALL ".join(f"SELECT k AS page_id, '{kind}' AS kind, CAST({n} AS BIGINT) AS n FROM ({_K})" for kind, n in _KINDS.items()) + ") SELECT page_id, kind, n FROM n WHERE n > 0")
def made_additional_content(spark, sf_dir):
    """Triggers, what they reveal, tooltips, popovers, disclosures, and the style sheets of pages that have any."""
    found = content.additional_content(materialize(elements(_made(spark, sf_dir, _SHOWN), _SLIM), "shown"))
    return found.groupBy("page_id", F.split("cls", r"\|")[0].alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_MAPS = (
    "'<html><head><title>' || CASE k % 3 WHEN 0 THEN 'Our Sitemap' WHEN 1 THEN 'The site map' ELSE 'Sitemaps' END || '</title></head><body><header><a href=/h>H</a></header><div role=contentinfo><a href=/i>I</a></div>' || "
    "CASE WHEN k % 2 = 0 THEN '<main>' ELSE '<div>' END || '<nav class=my-breadcrumbs><a href=/c>C</a></nav><a href=/n>none</a><h1>All</h1><nav><a href=/t>top</a></nav><section><h2>A</h2>' || repeat('<p><a href=/a>a</a></p>', k % 4) || "
    "'</section><h3>B</h3>' || repeat('<p><a href=/b>b</a></p>', k % 40) || CASE WHEN k % 2 = 0 THEN '</main>' ELSE '</div>' END || '<p><a href=/o>o</a></p></body></html>'"
)
_URL = "CASE WHEN k % 3 = 2 AND k % 5 = 0 THEN 'https://x.example/plan-du-site/' || k ELSE 'https://x.example/' || k END"


@query(
    f"WITH m AS (SELECT k FROM ({_K}) WHERE k % 3 < 2 OR k % 5 = 0), e AS (SELECT k, 'none' AS text, '/n' AS href, NULL AS section, 1 AS n FROM m UNION ALL SELECT k, 'top', '/t', 'All', 1 FROM m UNION ALL SELECT k, 'a', '/a', 'A', k % 4 FROM m UNION ALL "
    "SELECT k, 'b', '/b', 'B', k % 40 FROM m UNION ALL SELECT k, 'o', '/o', 'B', k % 2 FROM m), "
    "l AS (SELECT k, ['\"none\" → /n', '\"top\" → /t'] || list_transform(range(k % 4), x -> '\"a\" → /a') || list_transform(range(k % 40), x -> '\"b\" → /b') || list_transform(range(k % 2), x -> '\"o\" → /o') AS l FROM m) "
    "SELECT k AS page_id, 'entry' AS kind, text, href, section, CAST(n AS BIGINT) AS entries FROM e WHERE n > 0 UNION ALL SELECT k, 'page', array_to_string(l[1:30], ', '), NULL, NULL, CAST(len(l) AS BIGINT) FROM l"
)
def made_site_maps(spark, sf_dir):
    """Site maps by name or address, with their entries by section."""
    pages = _made(spark, sf_dir, _MAPS, _URL)
    found = content.site_maps(elements(pages, _SLIM), pages.select("page_id", "url"))
    return found.groupBy("page_id", "kind", "text", "href", "section").agg(F.sum("entries").alias("entries"))
