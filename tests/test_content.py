"""Evidence that relates the elements of a page: edges, precedence, orders, site maps, and the subjects made of them."""

import pytest
from pyspark.sql import functions as F

from lintel.operators import content, harvest
from lintel.sources.html import elements

PAGES = "page_id long, html string, url string"


def parsed(spark, *sources):
    return elements(spark.createDataFrame([(i, s, "https://x.example/a") for i, s in enumerate(sources)], PAGES))


def test_edges_take_the_first_word_and_the_first_bearer(spark):
    df = parsed(spark, '<b id=x>1</b><b id=x>2</b><a aria-describedby=" x y" aria-controls=x popovertarget="">t</a><i aria-details=no>n</i>', "<a aria-controls=x>other page</a>")
    got = [(r["page_id"], r["rel"], r["ref"], r["target_tag"], r["target_ord"] < r["ord"]) for r in content.reference_edges(df).orderBy("step").collect()]
    assert got == [(0, "aria-describedby", "x", "b", True), (0, "aria-controls", "x", "b", True)]


def classes(df):
    return [r["cls"] for r in df.orderBy("page_id", "ord").collect()]


def test_an_element_is_reported_once(spark):
    # A trigger that is a target of an earlier one, of itself, and a disclosure; a details element that something controls.
    df = parsed(spark, '<a aria-controls=b>1</a><button id=b aria-details=b aria-expanded=true>2</button><details id=d>x</details><a aria-controls=d aria-expanded=false>3</a><p popover role=tooltip id=e>y</p><a aria-details=e>4</a>')
    assert classes(content.additional_content(df)) == ["trigger|a|aria-controls|b", "revealed|b", "revealed|d", "trigger|a|aria-controls|d", "tooltip|y", "trigger|a|aria-details|e"]


def test_sheets_only_of_pages_that_reveal_something(spark):
    sheet = '<link rel="stylesheet" href=s.css>'
    df = parsed(spark, sheet, sheet + "<summary>s</summary>", sheet + "<style>p:hover{}</style>", "")
    assert classes(content.additional_content(df)) == ["stylesheet|s.css", "details|summary|s"]
    styled = spark.createDataFrame([(2,)], "page_id long")
    assert classes(content.additional_content(df, styled)) == ["stylesheet|s.css", "details|summary|s", "stylesheet|s.css"]


@pytest.mark.parametrize("html, stop", [
    ("<a href=x>t</a>", True), ("<a>t</a>", False), ("<a tabindex=0>t</a>", True), ("<a href=x tabindex=-1>t</a>", False), ("<a href=x tabindex=' -2x'>t</a>", False), ("<p tabindex=-0>t</p>", True), ("<p tabindex>t</p>", True),
    ("<button>t</button>", True), ("<button disabled>t</button>", False), ("<input>", True), ("<input type=HIDDEN>", False), ("<input type=hidden tabindex=1>", True), ("<p contenteditable>t</p>", True), ("<p contenteditable=false>t</p>", False),
    ("<iframe></iframe>", True), ("<area href=x>", True), ("<select hidden></select>", False), ("<p>t</p>", False), ("<a contenteditable>t</a>", False),
])
def test_what_tab_reaches(spark, html, stop):
    assert parsed(spark, html).where(content.tabbable()).count() == int(stop)


def test_orders_of_a_long_page(spark):
    long = "".join(f"<p><a href=x>n{i}</a></p>" for i in range(1500))
    df = parsed(spark, f"<nav>{long}</nav>", "<nav></nav>", "<p>none</p>")
    got = {r["page_id"]: r for r in content.tab_orders(df, 3).collect()}
    assert set(got) == {0} and got[0]["tab_order"] == 'a "n0" → a "n1" → a "n2"' and got[0]["stops"] == 1500
    blocks = {r["page_id"]: (r["link_order"], r["links"]) for r in content.repeated_blocks(df, 2).collect()}
    assert blocks == {0: ("n0 › n1", 1500), 1: ("", 0)}


def test_site_maps(spark):
    pages = spark.createDataFrame([(1, "<title>x</title><h1>Plan du site</h1><a href=/a>a</a>", "https://x.example/"), (2, "<a href=/b>b</a>", "https://x.example/sitemap.html"), (3, "<a href=/c>c</a>", None), (4, "<html><title>Sitemap</title><body>nothing</body></html>", ""), (5, None, "site-map")], PAGES)
    df = elements(pages)
    rows = content.site_maps(df, pages.select("page_id", "url")).select("page_id", "kind", "text", "section", "entries")
    got = sorted(tuple(r) for r in rows.collect())
    assert got == [(1, "entry", "a", "Plan du site", 1), (1, "page", '"a" → /a', None, 1), (2, "entry", "b", None, 1), (2, "page", '"b" → /b', None, 1), (4, "page", "", None, 0)]
    assert content.site_maps(df).where("page_id = 2").count() == 0
    assert content.site_maps(df.where("false")).count() == 0


def test_subjects_made_of_them(spark):
    pages = spark.createDataFrame([(1, "<title>Sitemap</title><link rel=stylesheet href=s><style>a:hover {}</style><a href=/a>a</a><button>b</button>", "u")], PAGES)
    rows = harvest.harvest(elements(pages), ["tabOrder", "additionalContent", "siteMapPage"], pages)
    want = [("additionalContent", "stylesheet|s"), ("siteMapPage", "sitemapentry|a|/a"), ("siteMapPage", "sitemapentry||s"), ("siteMapPage", "sitemappage|1"), ("tabOrder", "taborder|1")]
    got = sorted((r["subject"], r["cls"]) for r in rows.select("subject", F.col("cls")).collect())
    assert [x for x in got if not x[1].startswith("cssstate")] == sorted(want)
