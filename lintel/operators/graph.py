"""Closures over links, imports and modules: breadth-first by iterated joins.

Each round joins the frontier with the edges and drops what was reached before (anti join), so
a cycle ends it and every edge is followed once. Lineage is cut each round by a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.plans.storage import materialize


def reach(seeds: DataFrame, edges: DataFrame, depth: int | None = None, most: int | None = None) -> DataFrame:
    """(root, node, depth): everything reachable from each (root, node) of ``seeds`` over edges (src, dst).

    ``depth`` bounds the hops, ``most`` the nodes per root in order of (depth, node).
    """
    frontier = materialize(seeds.select("root", "node").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = frontier
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        step = frontier.join(edges.select(F.col("src").alias("node"), "dst").distinct(), "node").select("root", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(hop)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    if most is None:
        return seen
    order = F.row_number().over(Window.partitionBy("root").orderBy("depth", "node"))
    return seen.withColumn("n", order).where(F.col("n") <= most).drop("n")


def resolved(usages: DataFrame, bindings: DataFrame, components: DataFrame, hops: int = 20) -> DataFrame:
    """(file, name, def_file, def_name): where a used component is defined.

    ``bindings`` (file, local, target, imported) are imports and named re-exports, resolved to files;
    an imported ``*`` with the same local name re-exports everything. Follows chains of barrels;
    the shortest chain wins, ties to the smaller file.
    """
    named = bindings.where("imported <> '*'")
    stars = bindings.where("imported = '*' and local = '*'").select("file", "target")
    spaces = bindings.where("imported = '*' and local <> '*'").select("file", F.col("local").alias("space"), "target")
    dotted = usages.where(F.col("name").contains("."))
    split = dotted.select("file", "name", F.substring_index("name", ".", 1).alias("space"), F.expr("substring(name, instr(name, '.') + 1)").alias("member"))
    start = usages.where(~F.col("name").contains(".")).select("file", "name", F.col("file").alias("at"), F.col("name").alias("want"))
    start = start.unionByName(split.join(spaces, ["file", "space"]).select("file", "name", F.col("target").alias("at"), F.col("member").alias("want")))
    frontier, seen, found = start.distinct(), start.distinct(), None
    for hop in range(hops):
        here = frontier.join(components.select(F.col("file").alias("at"), F.col("name").alias("want")).distinct(), ["at", "want"])
        here = here.select("file", "name", F.col("at").alias("def_file"), F.col("want").alias("def_name"), F.lit(hop).alias("hop"))
        found = here if found is None else found.unionByName(here)
        on = frontier.join(named.select(F.col("file").alias("at"), F.col("local").alias("want"), "target", "imported"), ["at", "want"]).select("file", "name", F.col("target").alias("at"), F.col("imported").alias("want"))
        bound = frontier.join(named.select(F.col("file").alias("at"), F.col("local").alias("want")), ["at", "want"], "left_semi")
        free = frontier.join(bound, ["file", "name", "at", "want"], "left_anti")
        wide = free.join(stars.select(F.col("file").alias("at"), "target"), "at").select("file", "name", F.col("target").alias("at"), "want")
        step = on.unionByName(wide).distinct().join(seen, ["file", "name", "at", "want"], "left_anti")
        frontier = materialize(step, "hops")
        if not frontier.limit(1).count():
            break
        seen = materialize(seen.unionByName(frontier), "seen")
    best = F.min(F.struct("hop", "def_file", "def_name")).alias("b")
    return found.groupBy("file", "name").agg(best).select("file", "name", "b.def_file", "b.def_name")


NAME_PROPS = ("aria-label", "aria-labelledby", "title", "label", "alt")


def cross_findings(usages: DataFrame, definitions: DataFrame) -> DataFrame:
    """(file, line, rule_id, sc, severity) of the two cross-file rules with findings.

    ``usages``: file, line, name, spread, text, attrs map, def_file, def_name (resolved);
    ``definitions``: file, name, has_control, icon_only, accepts_name, control_has_name, reads array.
    """
    d = definitions.select(F.col("file").alias("def_file"), F.col("name").alias("def_name"), "has_control", "icon_only", "accepts_name", "control_has_name", "reads")
    rows = usages.join(d, ["def_file", "def_name"])
    given = F.filter(F.array(*[F.lit(p) for p in NAME_PROPS[:4]]), lambda p: F.trim(F.coalesce(F.col("attrs")[p], F.lit(""))) != "")
    any_name = F.exists(F.array(*[F.lit(p) for p in NAME_PROPS]), lambda p: F.trim(F.coalesce(F.col("attrs")[p], F.lit(""))) != "")
    named = F.col("spread") | (F.trim("text") != "") | any_name
    bare = rows.where(F.col("icon_only") & F.col("accepts_name") & ~named).select("file", "line", F.lit("cross-icon-only-unnamed").alias("rule_id"), F.lit("4.1.2").alias("sc"), F.lit("bloquant").alias("severity"))
    lost = rows.where(F.col("has_control") & ~F.col("accepts_name") & ~F.col("control_has_name") & F.col("reads").isNotNull() & (F.size(F.array_except(given, F.col("reads"))) > 0))
    return bare.unionByName(lost.select("file", "line", F.lit("cross-prop-drilled-name-lost").alias("rule_id"), F.lit("4.1.2").alias("sc"), F.lit("majeur").alias("severity")))


def cross_suppressed(findings: DataFrame, elements: DataFrame, ids: DataFrame, language_given: DataFrame) -> DataFrame:
    """``findings`` (page_id, ord, rule_id, detail, ...) without those that another file settles.

    ``ids``: every id of any file; ``language_given``: page_id of documents whose imported layout
    declares a language. Elements that take a spread keep no missing-name finding.
    """
    from lintel.functions.markup import spread

    known = ids.select("id").distinct()
    wanted = findings.where(F.col("rule_id").isin("skip-link-target-missing", "label-for-dangling")).select("page_id", "ord", "rule_id", F.col("detail").alias("id"))
    elsewhere = wanted.join(known, "id", "left_semi").select("page_id", "ord", "rule_id")
    refs = findings.where("rule_id = 'aria-ref-missing-id'").select("page_id", "ord", "rule_id", F.explode(F.regexp_extract_all("detail", F.lit("#([^, ]+)"), F.lit(1))).alias("id"))
    held = refs.join(known.withColumn("there", F.lit(True)), "id", "left").groupBy("page_id", "ord", "rule_id").agg(F.min(F.coalesce("there", F.lit(False))).alias("all_there"))
    layout = findings.where("rule_id = 'html-lang-missing'").join(language_given, "page_id", "left_semi").select("page_id", "ord", "rule_id")
    spreads = elements.where(spread() & F.col("tag").isin("button", "select", "textarea", "a", "input", "img")).select("page_id", "ord")
    names = ("icon-only-control-unnamed", "button-empty-name", "link-empty-name", "control-label-missing", "img-alt-missing")
    forwarded = findings.where(F.col("rule_id").isin(*names)).join(spreads, ["page_id", "ord"], "left_semi").select("page_id", "ord", "rule_id")
    out = elsewhere.unionByName(held.where("all_there").select("page_id", "ord", "rule_id")).unionByName(layout).unionByName(forwarded)
    return findings.join(out.distinct(), ["page_id", "ord", "rule_id"], "left_anti")


def affected_pages(pages: DataFrame, edges: DataFrame, changed: DataFrame, always: list[str]) -> DataFrame:
    """(page, reason): pages whose sources reach a changed file; all of them when a changed file is global.

    ``pages``: page, source; ``edges``: src, dst; ``changed``: file; ``always``: patterns of global files.
    """
    shared = changed.where(F.lit(False) if not always else F.col("file").rlike("|".join(always)))
    everyone = pages.select("page").distinct().join(shared.select(F.col("file").alias("reason")), F.lit(True)) if shared.limit(1).count() else None
    if everyone is not None:
        return everyone.groupBy("page").agg(F.min("reason").alias("reason"))
    closure = reach(pages.select(F.col("page").alias("root"), F.col("source").alias("node")), edges)
    hit = closure.join(changed.select(F.col("file").alias("node")).distinct(), "node", "left_semi")
    return hit.groupBy(F.col("root").alias("page")).agg(F.min("node").alias("reason"))


def suffixes(path: Column) -> Column:
    """A path's suffixes at folder boundaries, itself first."""
    parts = F.split(F.regexp_replace(path, "\\\\", "/"), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def by_suffix(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, page): the first page (smallest ``position``) one of whose sources is a path suffix of the
    file, or the other way round. Suffixes are exploded, so the match is an equi-join.

    ``files``: file; ``sources``: page, position, source.
    """
    one = files.select("file", F.explode(suffixes(F.col("file"))).alias("key")).join(sources.select("page", "position", F.regexp_replace("source", "\\\\", "/").alias("key")), "key")
    two = sources.select("page", "position", F.explode(suffixes(F.col("source"))).alias("key")).join(files.select("file", F.regexp_replace("file", "\\\\", "/").alias("key")), "key")
    both = one.select("file", "page", "position").unionByName(two.select("file", "page", "position"))
    return both.groupBy("file").agg(F.min_by("page", "position").alias("page"))
