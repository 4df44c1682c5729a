"""Integrity checks and page samples: every check is a query that returns its violations.

No rows means that the check passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.urls import fold


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


# --- reports


def report_differs(reported: DataFrame, derived: DataFrame) -> DataFrame:
    """(id, state): failed criteria that only the report has (invented) or only the audit has (omitted)."""
    a = reported.select("id").distinct().withColumn("r", F.lit(True))
    b = derived.where("status = 'NC'").select("id").distinct().withColumn("d", F.lit(True))
    both = a.join(b, "id", "full_outer")
    return both.where("r is null or d is null").select("id", F.when(F.col("r").isNull(), "omitted").otherwise("invented").alias("state"))


def totals_differ(stated: DataFrame, derived: DataFrame) -> DataFrame:
    """(status, stated, counted): totals of a report that the audit does not bear out. ``stated``: status, n."""
    counted = derived.groupBy("status").agg(F.count(F.lit(1)).alias("counted"))
    both = stated.join(counted, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).alias("stated"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return both.where("stated <> counted")


def undecided(criteria: DataFrame, allowed: DataFrame) -> DataFrame:
    """(sc, violation): open criteria without an allowance, allowances without a reason, and allowances nobody needs.

    ``allowed``: sc, reason.
    """
    given = allowed.where(~_blank("reason"))
    open_ = criteria.where("status = 'manual'").select("sc")
    return (
        open_.join(given.select("sc"), "sc", "left_anti").select("sc", F.lit("open").alias("violation"))
        .unionByName(allowed.where(_blank("reason")).select("sc", F.lit("no-reason").alias("violation")))
        .unionByName(given.select("sc").join(open_, "sc", "left_anti").select("sc", F.lit("needless").alias("violation")))
    )


def unrendered(criteria: DataFrame, snapshots: DataFrame, allowed: DataFrame) -> DataFrame:
    """(sc): criteria that need a rendered page and are open, where no page was rendered at all."""
    some = snapshots.select(F.lit(True).alias("any")).limit(1)
    open_ = criteria.where("status = 'manual' and automatability = 'needs-rendering'").select("sc")
    lacking = open_.join(allowed.where(~_blank("reason")).select("sc"), "sc", "left_anti")
    return lacking.join(F.broadcast(some), F.lit(True), "left_anti")  # one row


def uncaptured(declared: DataFrame, captured: DataFrame) -> DataFrame:
    """Declared pages (id, name, url) that no run captured (id)."""
    return declared.join(captured.select("id").distinct(), "id", "left_anti")


# --- samples of pages


def sample_problems(pages: DataFrame) -> DataFrame:
    """(position, problem) of a declared sample: position, id, name, url."""
    target = F.col("url").rlike("(?i)^https?://") | F.col("url").rlike("^([.]{1,2}[/\\\\]|[/\\\\])") | F.col("url").rlike("(?i)[.]x?html?$")
    first = pages.where(~_blank("id")).groupBy("id").agg(F.min("position").alias("first"))
    again = pages.join(first, "id").where(F.col("position") > F.col("first")).select("position", F.lit("duplicate id").alias("problem"))
    state = lambda cond, name: pages.where(cond).select("position", F.lit(name).alias("problem"))
    checks = [state(_blank("id"), "no id"), again, state(_blank("name"), "no name"), state(_blank("url"), "no url"), state(~_blank("url") & ~target, "malformed url")]
    return reduce(DataFrame.unionByName, checks)


def missing_kinds(pages: DataFrame, kinds: DataFrame) -> DataFrame:
    """Kinds of pages that a standard asks for and no page of the sample looks like.

    ``pages``: id, name, url, notes; ``kinds``: kind, keyword. Accents do not matter; keywords of up to four letters
    must be whole words. The tokens of pages are exploded and equi-joined with one-word keywords; longer ones, a fixed
    list, are searched for. A kind of representative pages is met by two pages.
    """
    hay = fold(F.concat_ws(" ", F.col("name"), F.coalesce("notes", F.lit("")), F.col("url"), F.col("id")))
    words = pages.select(hay.alias("hay")).distinct()
    asked = kinds.select("kind", fold(F.col("keyword")).alias("k")).where("k <> ''").distinct()
    short = asked.where("length(k) <= 4 and not k rlike '[^a-z0-9]'")
    by_word = words.select(F.explode(F.array_distinct(F.split("hay", "[^a-z0-9]+"))).alias("k")).distinct().join(short, "k").select("kind")
    by_part = words.join(F.broadcast(asked.where("length(k) > 4 or k rlike '[^a-z0-9]'")), F.contains(F.col("hay"), F.col("k"))).select("kind")  # the keywords of a standard
    many = pages.agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    several = kinds.where("kind like '%representative%'").select("kind").join(F.broadcast(many), F.lit(True), "left_semi")  # one row
    return kinds.select("kind").distinct().join(by_word.unionByName(by_part).unionByName(several).distinct(), "kind", "left_anti")


def sample_drift(declared: DataFrame, captured: DataFrame) -> DataFrame:
    """(id, state) of the united inventory: both, undeclared or uncaptured. Pages are told apart by id alone."""
    both = declared.select("id").distinct().withColumn("d", F.lit(True)).join(captured.select("id").distinct().withColumn("c", F.lit(True)), "id", "full_outer")
    return both.select("id", F.when(F.col("d").isNull(), "undeclared").when(F.col("c").isNull(), "uncaptured").otherwise("both").alias("state"))


def merged_sample(declared: DataFrame, proposed: DataFrame) -> DataFrame:
    """Declared pages as they are, and of the proposed ones those with a new address, under a free id.

    Both: id, name, url, position.
    """
    from lintel.functions.urls import free_ids

    fresh = proposed.join(declared.select("url").distinct(), "url", "left_anti")
    first = fresh.groupBy("url").agg(F.min_by(F.struct("id", "name", "position"), "position").alias("p")).select("p.*", "url")
    kept = declared.withColumn("origin", F.lit(0)).unionByName(first.withColumn("origin", F.lit(1)))
    return free_ids(kept, "id", ["origin", "position"]).select("id", "name", "url", "position", F.when(F.col("origin") == 0, "kept").otherwise("added").alias("state"))


def united_scope(first: DataFrame, second: DataFrame) -> DataFrame:
    """(kind, item, times): what two runs looked at, each once, and how many of them did."""
    both = first.select("kind", "item").distinct().unionByName(second.select("kind", "item").distinct())
    return both.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("times"))


# --- measurements by other tools


def axe_findings(nodes: DataFrame) -> DataFrame:
    """(page_id, rule_id, sc, severity, target): reported nodes as findings, one per criterion that their tags name.

    ``nodes``: page_id, rule, impact, tags array, target. Tags read wcag followed by the digits of a criterion.
    """
    tags = F.transform(F.filter("tags", lambda t: t.rlike("^wcag[1-4][0-9]{2,3}$")), lambda t: F.concat_ws(".", F.substring(t, 5, 1), F.substring(t, 6, 1), F.substring(t, 7, 2)))
    severity = F.when(F.col("impact") == "critical", "bloquant").when(F.col("impact") == "serious", "majeur").otherwise("mineur")
    return nodes.select("page_id", F.concat(F.lit("axe:"), F.col("rule")).alias("rule_id"), F.explode(F.array_distinct(tags)).alias("sc"), severity.alias("severity"), "target")


def probe_outcomes(probed: DataFrame, hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(sc, hits, proven): per measured criterion its failures, and whether every page was measured without one.

    ``probed``: page_id, sc; ``hits``: page_id, sc; ``pages``: page_id.
    """
    n = pages.select("page_id").distinct().agg(F.count(F.lit(1)).alias("pages"))
    seen = probed.groupBy("sc").agg(F.count_distinct("page_id").alias("measured"))
    failed = hits.groupBy("sc").agg(F.count(F.lit(1)).alias("hits"))
    rows = seen.join(failed, "sc", "left").crossJoin(F.broadcast(n))  # one row
    found = F.coalesce("hits", F.lit(0))
    return rows.select("sc", found.alias("hits"), ((found == 0) & (F.col("measured") == F.col("pages"))).alias("proven"))
