"""Review of open criteria: worklists, verdicts folded in, audits merged, findings withdrawn, rates and tallies.

Statuses are C, NC, NA and manual; ``decided_by`` is engine, scan, agent or human. Every operator is a
join, a window or an aggregate keyed by criterion, page or finding, and none collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.operators.verdicts import dotted, rank


def _normative(findings: DataFrame) -> DataFrame:
    return findings.groupBy("sc").agg(F.count_if(~F.col("advisory")).alias("normative"))


# --- worklists


def worklist(criteria: DataFrame, subjects: DataFrame, evidence: DataFrame, most_classes: int = 1200, shown: int = 8) -> DataFrame:
    """(sc, subject, cls, occurrences, pages, page_id, ord, also_at, left_out): what a reviewer of open criteria reads.

    ``criteria``: sc, status; ``subjects``: sc, subject; ``evidence``: subject, cls, page_id, ord. Each class
    stands for its first place; ``also_at`` lists up to ``shown`` more places; of a subject the
    ``most_classes`` commonest classes are listed, and ``left_out`` says how many there are besides.
    """
    nth = F.row_number().over(Window.partitionBy("subject", "cls").orderBy("page_id", "ord"))
    first = evidence.withColumn("nth", nth).where(F.col("nth") <= shown + 1)
    places = first.groupBy("subject", "cls").agg(F.array_sort(F.collect_list(F.struct("page_id", "ord"))).alias("places"))  # shown + 1 at most
    classes = evidence.groupBy("subject", "cls").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("page_id").alias("pages")).join(places, ["subject", "cls"])
    order = Window.partitionBy("subject").orderBy(F.desc("occurrences"), "cls")
    kept = classes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_classes)
    total = evidence.groupBy("subject").agg(F.greatest(F.count_distinct("cls") - most_classes, F.lit(0)).alias("left_out"))
    asked = criteria.where("status = 'manual'").select("sc").join(subjects, "sc").join(kept, "subject").join(total, "subject")
    also = F.transform(F.slice("places", 2, shown), lambda p: F.concat_ws(":", p["page_id"].cast("string"), p["ord"].cast("string")))
    return asked.select("sc", "subject", "cls", "occurrences", "pages", F.col("places")[0]["page_id"].alias("page_id"), F.col("places")[0]["ord"].alias("ord"), F.array_join(also, " ").alias("also_at"), "left_out")


def verify_list(findings: DataFrame, most: int = 40) -> DataFrame:
    """The claims to verify: normative findings, most severe first, ``most`` of them (the cap is the feature), numbered from 1."""
    chosen = findings.where("not advisory").orderBy(rank(F.col("severity")), "sc", "page_id", "line", "finding_id").limit(most)
    number = F.row_number().over(Window.orderBy(rank(F.col("severity")), "sc", "page_id", "line", "finding_id"))  # at most ``most`` rows
    return chosen.select(number.alias("n"), "finding_id", "sc", "page_id", "line", "severity")


def first_of_subject(evidence: DataFrame, most: int) -> DataFrame:
    """The first ``most`` places of each subject on each page, in document order."""
    nth = F.row_number().over(Window.partitionBy("page_id", "subject").orderBy("ord"))
    return evidence.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


# --- verdicts


def folded(criteria: DataFrame, verdicts: DataFrame, violations: DataFrame, strict: bool = False) -> DataFrame:
    """(sc, status, decided_by): criteria with the verdicts that broke no rule.

    ``verdicts``: sc, verdict, decided_by; ``violations``: sc, violation. ``strict`` refuses all of them
    when one is refused; otherwise a refusal costs its own criterion. Only open criteria take a verdict.
    """
    good = verdicts.join(violations.select("sc").distinct(), "sc", "left_anti").where(F.col("verdict").isin("C", "NC", "NA"))
    if strict:
        refused = violations.agg(F.count(F.lit(1)).alias("refused"))
        good = good.crossJoin(F.broadcast(refused)).where("refused = 0").drop("refused")  # one row
    rows = criteria.join(good.select("sc", "verdict", F.col("decided_by").alias("by")), "sc", "left")
    taken = (F.col("status") == "manual") & F.col("verdict").isNotNull()
    return rows.select("sc", F.when(taken, F.col("verdict")).otherwise(F.col("status")).alias("status"), F.when(taken, F.col("by")).when(F.col("status") != "manual", "engine").alias("decided_by"))


def automatic_rate(criteria: DataFrame) -> DataFrame:
    """One row: the conformance rate without conformities that were ruled by an agent or a person."""
    own = F.coalesce(F.col("decided_by").isin("engine", "scan"), F.lit(True))
    c, nc = F.count_if((F.col("status") == "C") & own), F.count_if(F.col("status") == "NC")
    return criteria.agg(c.alias("conforming"), (c + nc).alias("decided"), F.when(c + nc == 0, 100).otherwise(F.floor(100 * c / (c + nc) + 0.5)).cast("long").alias("pct"))


def provenance(criteria: DataFrame) -> DataFrame:
    """One row: how many decided criteria the engine, a scan, an agent and a person settled."""
    decided = criteria.where("status <> 'manual'")
    by = F.coalesce("decided_by", F.lit("engine"))
    return decided.agg(*[F.count_if(by == k).alias(k) for k in ("engine", "scan", "agent", "human")])


def levels(criteria: DataFrame, scale: DataFrame) -> DataFrame:
    """(name, least, reached, missing): for each step of a scale whether the rate reaches it, and how many conformities it lacks.

    The rate is conforming over decided and open criteria that apply; ``scale``: name, least (percent).
    """
    applies = F.col("status").isin("C", "NC", "manual")
    totals = criteria.agg(F.count_if(F.col("status") == "C").alias("c"), F.count_if(applies).alias("a"))
    rows = scale.crossJoin(F.broadcast(totals))  # one row
    need = F.ceil(F.col("least") * F.col("a") / 100)
    return rows.select("name", "least", (F.col("c") >= need).alias("reached"), F.greatest(need - F.col("c"), F.lit(0)).cast("long").alias("missing"))


def on_page(verdicts: DataFrame, citations: DataFrame, page_id: int) -> DataFrame:
    """Verdicts that cite the page: ``citations`` has sc, page_id."""
    return verdicts.join(citations.where(F.col("page_id") == page_id).select("sc").distinct(), "sc", "left_semi")


# --- merges


def merged_scan(criteria: DataFrame, findings: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(criteria, findings) with what a rendered run found besides.

    Findings are united by identity, the earlier ones first; a criterion that now has a normative finding fails,
    and is without object no longer.
    """
    both = findings.unionByName(scanned.join(findings.select("finding_id").distinct(), "finding_id", "left_anti"))
    rows = criteria.join(_normative(both), "sc", "left")
    fails = F.coalesce("normative", F.lit(0)) > 0
    status = F.when(fails, "NC").otherwise(F.col("status"))
    return rows.select("sc", status.alias("status"), (F.col("inapplicable") & ~fails).alias("inapplicable")), both


def merged_audits(first: DataFrame, second: DataFrame) -> DataFrame:
    """(sc, status, inapplicable) of two audits of different pages, by full outer join.

    A failure in either fails; a criterion closed only because one audit saw nothing of its subject takes
    the other's status; open in either stays open; without object only where both say so.
    """
    a = first.select("sc", F.col("status").alias("s1"), F.col("inapplicable").alias("i1"))
    b = second.select("sc", F.col("status").alias("s2"), F.col("inapplicable").alias("i2"))
    absent = lambda s, i: F.col(s).isNull() | F.coalesce(F.col(i), F.lit(False))
    rows = a.join(b, "sc", "full_outer")
    either = lambda v: F.coalesce(F.col("s1") == v, F.lit(False)) | F.coalesce(F.col("s2") == v, F.lit(False))
    status = (
        F.when(either("NC"), "NC")
        .when(absent("s1", "i1") & F.col("s2").isNotNull(), F.col("s2"))
        .when(absent("s2", "i2") & F.col("s1").isNotNull(), F.col("s1"))
        .when(either("manual"), "manual")
        .when(either("C"), "C")
        .otherwise("NA")
    )
    gone = F.coalesce("i1", F.lit(True)) & F.coalesce("i2", F.lit(True)) & ~either("NC")
    return rows.select("sc", status.alias("status"), gone.alias("inapplicable"))


def withdrawn(criteria: DataFrame, findings: DataFrame, refuted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(criteria, findings) without the refuted findings; a failed criterion that has none left is open again."""
    left = findings.join(refuted.select("finding_id").distinct(), "finding_id", "left_anti")
    lost = findings.join(refuted.select("finding_id").distinct(), "finding_id", "left_semi").select("sc").distinct().withColumn("lost", F.lit(True))
    rows = criteria.join(_normative(left), "sc", "left").join(lost, "sc", "left")
    reopened = (F.col("status") == "NC") & F.coalesce("lost", F.lit(False)) & (F.coalesce("normative", F.lit(0)) == 0)
    return rows.select("sc", F.when(reopened, "manual").otherwise(F.col("status")).alias("status")), left


def merged_order(findings: DataFrame) -> DataFrame:
    """Adds ``place`` from 1: most severe first, otherwise as they came (``seq``). Numbered in two levels, by severity and page."""
    key = rank(F.col("severity"))
    counts = findings.groupBy(key.alias("r"), "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("from"))
    before = Window.orderBy("r", "from", "page_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per severity and page
    offsets = counts.select("r", "page_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("page_id", "severity").orderBy("seq"))
    rows = findings.withColumn("r", key).withColumn("k", inside).join(offsets, ["r", "page_id"])
    return rows.withColumn("place", F.col("before") + F.col("k")).drop("r", "k", "before")


# --- packs and outside audits


def findings_for(findings: DataFrame, crosswalk: DataFrame, applies: DataFrame, overrides: DataFrame) -> DataFrame:
    """Findings that a standards pack has a criterion for, each once, with the pack's severity class.

    ``crosswalk``: id, sc; ``applies``: id, pattern; ``overrides``: rule_id, advisory.
    """
    from lintel.operators.packs import rule_matches

    limited = applies.select("id").distinct().withColumn("limited", F.lit(True))
    pairs = findings.select("finding_id", "sc", "rule_id").join(crosswalk, "sc").join(limited, "id", "left")
    free = pairs.where("limited is null").select("finding_id")
    gated = pairs.where("limited").join(applies, "id").where(rule_matches(F.col("rule_id"), F.col("pattern"))).select("finding_id")
    eligible = findings.join(free.unionByName(gated).distinct(), "finding_id", "left_semi").dropDuplicates(["finding_id"])
    out = eligible.join(overrides.select("rule_id", F.col("advisory").alias("o")), "rule_id", "left")
    return out.withColumn("advisory", F.coalesce("o", "advisory")).drop("o")


def rates_by(derived: DataFrame, *keys: str) -> DataFrame:
    """conforming, failing, open and pct of a pack's criteria, overall or by theme."""
    c, nc = F.count_if(F.col("status") == "C"), F.count_if(F.col("status") == "NC")
    pct = F.when(c + nc == 0, 100).otherwise(F.floor(100 * c / (c + nc) + 0.5)).cast("long")
    return derived.groupBy(*keys).agg(c.alias("conforming"), nc.alias("failing"), F.count_if(F.col("status") == "manual").alias("open"), pct.alias("pct"))


def external_diff(earlier: DataFrame, now: DataFrame) -> DataFrame:
    """(page, criterion, bucket): an outside audit's failures against today's, by full outer join.

    Both sides: page, criterion, failures (a count), tested. fixed, unchanged, partially fixed, regressed or not retested.
    """
    a = earlier.select("page", "criterion", F.col("failures").alias("f1"))
    b = now.select("page", "criterion", F.col("failures").alias("f2"), F.col("tested").alias("t2"))
    rows = a.join(b, ["page", "criterion"], "full_outer")
    f1, f2 = F.coalesce("f1", F.lit(0)), F.coalesce("f2", F.lit(0))
    bucket = (
        F.when((f1 > 0) & ~F.coalesce("t2", F.lit(False)), "not retested")
        .when((f1 > 0) & (f2 == 0), "fixed")
        .when((f1 > 0) & (f2 < f1), "partially fixed")
        .when(f2 > f1, "regressed")
        .otherwise("unchanged")
    )
    return rows.where((f1 > 0) | (f2 > 0)).select("page", "criterion", bucket.alias("bucket"))


# --- counts


def occurrences_by_page(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, occurrences, place): pages by how much they show, most first; ties by the order of ``pages`` (page_id, position)."""
    counts = evidence.groupBy("page_id").agg(F.count(F.lit(1)).alias("occurrences")).join(pages, "page_id")
    place = F.row_number().over(Window.orderBy(F.desc("occurrences"), "position"))  # one row per page of the sample
    return counts.select("page_id", "occurrences", place.alias("place"))


def cheapest_tier(options: DataFrame, tiers: list[str]) -> DataFrame:
    """(sc, tier): the cheapest means that can decide a criterion. ``options``: sc, tier; ``tiers`` from cheap to dear."""
    place = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier"))
    best = options.where(place > 0).groupBy("sc").agg(F.min(place).alias("p"))
    return best.select("sc", F.element_at(F.array(*[F.lit(t) for t in tiers]), F.col("p").cast("int")).alias("tier"))


def tier_census(criteria: DataFrame, tier: str = "automatability") -> DataFrame:
    return criteria.groupBy(F.col(tier).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def criteria_view(criteria: DataFrame, level: str | None = None, prefix: str | None = None) -> DataFrame:
    """Criteria of a level or below a dotted number, in numeric order."""
    rows = criteria.where(F.col("level") == level) if level else criteria
    rows = rows.where(F.startswith(F.concat("sc", F.lit(".")), F.lit(prefix + "."))) if prefix else rows
    return rows.orderBy(dotted(F.col("sc")))


def capture_coverage(components: DataFrame, captures: DataFrame) -> DataFrame:
    """(file, name, covered): components whose markup only shows when rendered, and whether a capture shows them.

    ``components``: file, name, has_control, opaque; ``captures``: source, component (null: the whole file). Files
    match when one path is a suffix of the other; suffixes are exploded, so the match is an equi join.
    """
    from lintel.operators.graph import suffixes

    asked = components.where("has_control or opaque").select("file", "name").distinct()
    one = asked.select("file", "name", F.explode(suffixes(F.col("file"))).alias("key")).join(captures.select(F.col("source").alias("key"), "component"), "key")
    two = asked.withColumn("key", F.col("file")).join(captures.select(F.explode(suffixes(F.col("source"))).alias("key"), "component"), "key")
    both = one.select("file", "name", "component").unionByName(two.select("file", "name", "component"))
    hit = both.where(F.col("component").isNull() | (F.col("component") == F.col("name"))).select("file", "name").distinct().withColumn("covered", F.lit(True))
    return asked.join(hit, ["file", "name"], "left").select("file", "name", F.coalesce("covered", F.lit(False)).alias("covered"))


def limited_files(files: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``most`` files by tier and path, one row with how many were read and how many left out)."""
    kept = files.orderBy("tier", "path").limit(most)
    return kept, files.agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("read"), F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("left_out"))


# --- grounding


def _loose(text: Column) -> Column:
    """Text as citations are compared: plain quotes, single spaces."""
    quotes = F.translate(text, "‘’“” ", "''\"\" ")
    return F.trim(F.regexp_replace(quotes, "\\s+", " "))


def grounded(citations: DataFrame, sources: DataFrame, window: int = 10) -> DataFrame:
    """(citation, state): whether a quoted snippet stands where it is said to.

    ``citations``: citation, file, line, snippet; ``sources``: file, source. found within ``window`` lines, moved
    elsewhere in the file, missing, out-of-range or no-file. Each citation reads its own file's row.
    """
    rows = citations.join(sources, "file", "left").withColumn("lines", F.split("source", "\n"))
    lo = F.greatest(F.col("line") - window, F.lit(1))
    near = F.array_join(F.slice("lines", lo, F.least(F.col("line") + window, F.size("lines")) - lo + 1), "\n")
    quoted = _loose(F.col("snippet"))
    here = F.when(F.col("line") >= 1, near).otherwise(F.col("source"))
    state = (
        F.when(F.col("source").isNull(), "no-file")
        .when(F.col("line") > F.size("lines"), "out-of-range")
        .when(quoted == "", "found")
        .when(F.contains(_loose(here), quoted), "found")
        .when(F.contains(_loose(F.col("source")), quoted), "moved")
        .otherwise("missing")
    )
    return rows.select("citation", state.alias("state"))
