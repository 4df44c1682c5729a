"""Evidence that relates the elements of a page: orders, repeated blocks, content that something reveals, site maps.

Elements meet by page and place (``tree``) or by page and id, so no page has to fit a task. Nothing here limits how many rows are
found; orders show their first entries and say how many there are.

Edge cases: a page without such elements gives no row; of elements with one id the first counts; empty ids and references to nothing are no
edges; null attributes are missing ones; equal page ids are one page; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.markup import attr, has, role, tag, trim
from lintel.operators import tree
from lintel.plans.storage import materialize

#: Attributes that point at the content they reveal, in order of precedence.
RELATIONS = ["aria-describedby", "aria-details", "aria-controls", "popovertarget"]
#: How a site map names itself, and its address.
_SITE_MAP_NAME = r"(?i)\bplan du site\b|\bsite ?map\b"
_SITE_MAP_ADDRESS = r"(?i)plan[-_]du[-_]site|sitemap|site[-_]map"
_CRUMBS = "(?i)fil d|breadcrumb"
_MAIN, _CHROME, _CRUMB = 1, 2, 4


def _said(name: str) -> Column:
    return F.coalesce(attr(name), F.lit(""))


def _text(n: int) -> Column:
    return F.substring(F.coalesce("text", F.lit("")), 1, n)


def _cls(kind: str, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _listed(found: str, between: str) -> Column:
    return F.array_join(F.transform(F.col(found), lambda x: x["value"]), between)


def tabbable() -> Column:
    """Whether Tab stops at the element: a tabindex of 0 or more, or what browsers make a stop, unless disabled or hidden."""
    given = F.regexp_extract(_said("tabindex"), r"^\s*(-\d+)", 1).try_cast("double")
    by_nature = tag("button", "select", "textarea", "iframe", "summary") | (tag("a", "area") & has("href")) | (tag("input") & (F.lower(_said("type")) != "hidden"))
    editable = ~tag("a", "area", "input") & (F.coalesce(attr("contenteditable"), F.lit("false")) != "false")
    return ~F.coalesce(given < 0, F.lit(False)) & ~has("disabled") & ~has("hidden") & (has("tabindex") | by_nature | editable)


def tab_orders(elements: DataFrame, shown: int = 15) -> DataFrame:
    """(page_id, ord, tab_order, stops): per page its first stop, the first ``shown`` stops as one string, and how many there are."""
    name = F.coalesce(*[F.when(c != "", c) for c in (_text(20), _said("aria-label"), _said("name"))], F.lit(""))
    index = F.when(has("tabindex"), F.concat(F.lit("[tabindex="), attr("tabindex"), F.lit("]"))).otherwise("")
    stops = elements.where(tabbable()).select("page_id", "ord", F.concat("tag", index, F.lit(' "'), name, F.lit('"')).alias("label"))
    out = tree.first_of(stops, ["page_id"], shown, F.col("label"))
    return out.select("page_id", F.col("first")[0]["ord"].alias("ord"), _listed("first", " → ").alias("tab_order"), F.col("n").alias("stops"))


def repeated_blocks(elements: DataFrame, shown: int = 20) -> DataFrame:
    """(page_id, ord, tag, link_order, links): every header, nav and footer with the first ``shown`` links in it as one string, and how many it has."""
    blocks = elements.where(tag("header", "nav", "footer")).select("page_id", "ord", "last_ord", "tag")
    links = elements.where(tag("a")).select("page_id", "ord", _text(24).alias("label"))
    found = tree.first_below(blocks, links, shown, F.col("label"))
    out = blocks.join(found, ["page_id", "ord"], "left")
    return out.select("page_id", "ord", "tag", F.coalesce(_listed("first", " › "), F.lit("")).alias("link_order"), F.coalesce("n", F.lit(0)).alias("links"))


def reference_edges(elements: DataFrame) -> DataFrame:
    """(page_id, ord, tag, step, rel, ref, target_ord, target_tag): an edge from every element to the element whose id the first word of one of
    :data:`RELATIONS` names; ``step`` is the relation's place in that list."""
    refs = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(rel).alias("rel"), F.split(trim(_said(rel)), r"\s+")[0].alias("ref")) for i, rel in enumerate(RELATIONS)])
    asks = elements.where(F.greatest(*[has(rel) for rel in RELATIONS])).select("page_id", "ord", "tag", F.explode(refs).alias("r")).select("page_id", "ord", "tag", "r.*").where("ref <> ''")
    ids = elements.where(_said("id") != "").select("page_id", attr("id").alias("ref"), "ord", "tag")
    ids = ids.groupBy("page_id", "ref").agg(F.min(F.struct("ord", "tag")).alias("t"))
    return asks.join(ids, ["page_id", "ref"]).select("page_id", "ord", "tag", "step", "rel", "ref", F.col("t.ord").alias("target_ord"), F.col("t.tag").alias("target_tag"))


def additional_content(elements: DataFrame, css_pages: DataFrame | None = None) -> DataFrame:
    """(page_id, ord, cls): content shown on hover, focus or activation, and what reveals it.

    Kinds: ``tooltip``, ``popover``, ``trigger`` and ``revealed`` (both ends of an edge), ``disclosure``, ``details``; an element has one,
    the first in that order, where the edges of elements that stand earlier come first. ``stylesheet`` names the sheets of
    pages that have any of these or are in ``css_pages`` (page_id), whose sources style such states.
    """
    at = lambda part, ord_, step: F.struct(F.lit(part).alias("part"), ord_.alias("place"), F.lit(step).cast("int").alias("step") if isinstance(step, int) else step.cast("int").alias("step"))
    here = F.col("ord")
    shapes = [
        (attr("role") == "tooltip", at(1, here, 0), _cls("tooltip", _text(40))),
        (has("popover"), at(1, here, 1), _cls("popover", _text(40))),
        (has("aria-expanded"), at(2, here, 2 * len(RELATIONS)), _cls("disclosure", F.col("tag"), _text(40))),
        (tag("details", "summary"), at(3, here, 0), _cls("details", F.col("tag"), _text(40))),
    ]
    own = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(rank.alias("rank"), cls.alias("cls"))) for c, rank, cls in shapes]))
    found = elements.select("page_id", "ord", F.explode(own).alias("h")).select("page_id", "ord", "h.rank", "h.cls")
    ends = F.array(
        F.struct(here.alias("ord"), at(2, here, 2 * F.col("step")).alias("rank"), _cls("trigger", F.col("tag"), F.col("rel"), F.col("ref")).alias("cls")),
        F.struct(F.col("target_ord").alias("ord"), at(2, here, 2 * F.col("step") + 1).alias("rank"), _cls("revealed", F.col("ref")).alias("cls")),
    )
    edges = reference_edges(elements).select("page_id", F.explode(ends).alias("e")).select("page_id", "e.ord", "e.rank", "e.cls")
    once = found.unionByName(edges).groupBy("page_id", "ord").agg(F.min_by("cls", "rank").alias("cls"))
    sheets = elements.where(tag("link") & F.array_contains(F.split(F.lower(_said("rel")), r"\s+"), "stylesheet")).select("page_id", "ord", _cls("stylesheet", _said("href")).alias("cls"))
    holding = once.select("page_id") if css_pages is None else once.select("page_id").unionByName(css_pages.select("page_id"))
    return once.unionByName(sheets.join(holding, "page_id", "left_semi"))


def site_maps(elements: DataFrame, urls: DataFrame | None = None, shown: int = 30) -> DataFrame:
    """(page_id, ord, kind, text, href, section, entries): the site maps among the pages, and their entries.

    A page is one when an h1 or its title says so, or its address in ``urls`` (page_id, url). A row of kind ``entry`` is an
    element with an address (a style sheet's link too), inside the first main or, without one, outside header and footer, and in no breadcrumb;
    ``section`` is the text of the last heading before it, null without one. The row of kind ``page`` stands at the first h1 (else main, html,
    entry), its text lists the first ``shown`` entries, and ``entries`` says how many there are.
    """
    sites = elements.where(tag("h1", "title") & _text(80).rlike(_SITE_MAP_NAME)).select("page_id")
    if urls is not None:
        sites = sites.unionByName(urls.where(F.col("url").rlike(_SITE_MAP_ADDRESS)).select("page_id"))
    kept = tag("html", "main", "header", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6") | has("href") | role().isin("banner", "contentinfo")
    held = materialize(elements.where(kept).join(sites, "page_id", "left_semi").select("page_id", "ord", "last_ord", "tag", "attrs", "text"), "site-maps")
    mains = held.where(tag("main")).groupBy("page_id").agg(F.min(F.struct("ord", "last_ord")).alias("m")).select("page_id", "m.*")
    chrome = held.where(tag("header", "footer") | role().isin("banner", "contentinfo")).select("page_id", "ord", "last_ord", F.lit(_CHROME).alias("flags"))
    crumbs = held.where(tag("nav") & F.concat_ws(" ", _said("aria-label"), _said("class")).rlike(_CRUMBS)).select("page_id", "ord", "last_ord", F.lit(_CRUMB).alias("flags"))
    around = mains.select("page_id", "ord", "last_ord", F.lit(_MAIN).alias("flags")).unionByName(chrome).unionByName(crumbs)
    linked = held.where(has("href")).select("page_id", "ord", _text(60).alias("text"), attr("href").alias("href"))
    flags = tree.flags_above(linked, around)
    flagged = linked.join(flags, ["page_id", "ord"], "left").join(mains.select("page_id", F.lit(True).alias("has_main")), "page_id", "left")
    flag = lambda bit: F.coalesce(F.col("flags").bitwiseAND(bit) > 0, F.lit(False))
    entries = flagged.where(F.when(F.col("has_main"), flag(_MAIN)).otherwise(~flag(_CHROME)) & ~flag(_CRUMB)).select("page_id", "ord", "text", "href")
    headings = held.where(tag("h1", "h2", "h3", "h4", "h5", "h6"))
    sections = tree.last_before(entries, headings, _text(80)).withColumnRenamed("value", "section")
    label = F.concat(F.lit('"'), F.substring("text", 1, 30), F.lit('" → '), F.col("href"))
    listed = tree.first_of(entries, ["page_id"], shown, label)
    rank = F.when(tag("h1"), 0).when(tag("main"), 1).when(tag("html"), 2)
    heads = held.where(rank.isNotNull()).select("page_id", F.struct(rank.alias("rank"), "ord").alias("head"))
    heads = heads.unionByName(listed.select("page_id", F.struct(F.lit(3).alias("rank"), F.col("first")[0]["ord"].alias("ord")).alias("head")))
    heads = heads.groupBy("page_id").agg(F.min("head").alias("head")).join(listed, "page_id", "left")
    none = F.lit(None).cast("string")
    whole = heads.select("page_id", "head.ord", F.lit("page").alias("kind"), F.coalesce(_listed("first", ", "), F.lit("")).alias("text"), none.alias("href"), none.alias("section"), F.coalesce("n", F.lit(0)).alias("entries"))
    each = entries.join(sections, ["page_id", "ord"]).select("page_id", "ord", F.lit("entry").alias("kind"), "text", "href", "section", F.lit(1).cast("long").alias("entries"))
    return whole.unionByName(each)
