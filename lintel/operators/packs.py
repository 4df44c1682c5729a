"""Standards packs: a crosswalk from success criteria, and declarative rules compiled to queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.markup import attr


def _match(node: dict) -> Column:
    """Own conditions of a match node: tag, attributes, text."""
    cond = F.lit(True)
    if node.get("tag"):
        cond = cond & (F.col("tag") == node["tag"].lower())
    for a in node.get("attrs", ()):
        value, op = attr(a["name"].lower()), a["op"]
        if op == "present":
            cond = cond & value.isNotNull()
        elif op == "absent":
            cond = cond & value.isNull()
        elif op == "equals":
            cond = cond & F.coalesce(value == a["value"], F.lit(False))
        else:
            cond = cond & F.coalesce(value.rlike(a["value"]), F.lit(False))
    if node.get("text"):
        hit = F.col("text").rlike(node["text"]["value"])
        cond = cond & (hit if node["text"]["op"] == "matches" else ~hit)
    return cond


def matching(elements: DataFrame, node: dict, depth: int = 1) -> DataFrame:
    """Elements that match a node; has and lacks are semi and anti joins on subtree intervals, up to three levels."""
    rows = elements.where(_match(node))
    for kind, how in (("has", "left_semi"), ("lacks", "left_anti")):
        for sub in node.get(kind, ()):
            inner = matching(elements, sub, depth + 1) if depth < 3 else elements.where("false")
            inner = inner.select(F.col("page_id").alias("p"), F.col("ord").alias("o"))
            rows = rows.join(inner, (F.col("page_id") == F.col("p")) & (F.col("o") > F.col("ord")) & (F.col("o") <= F.col("last_ord")), how)
    return rows


def pack_findings(elements: DataFrame, pack: str, rules: list[dict]) -> DataFrame:
    """(page_id, ord, rule_id, sc, severity, advisory) of a pack's declarative rules."""
    out = None
    full = elements.where("tag = 'html'").select("page_id").distinct()
    for rule in rules:
        base = elements.join(full, "page_id", "left_semi") if rule["match"].get("scope") == "page" else elements
        rows = matching(base, rule["match"]).select("page_id", "ord", F.lit(f"pack:{pack}:{rule['id']}").alias("rule_id"), F.lit(rule["sc"]).alias("sc"), F.lit(rule["severity"]).alias("severity"), F.lit(bool(rule.get("advisory"))).alias("advisory"))
        out = rows if out is None else out.unionByName(rows)
    return out


def rule_matches(rule: Column, pattern: Column) -> Column:
    """Exact, a prefix ending in :* or -*, or a bare *."""
    prefix = F.regexp_replace(pattern, "\\*$", "")
    return (pattern == "*") | (rule == pattern) | (pattern.rlike("[:-]\\*$") & F.startswith(rule, prefix))


def derived(criteria: DataFrame, findings: DataFrame, crosswalk: DataFrame, applies: DataFrame, overrides: DataFrame) -> DataFrame:
    """(id, status, normative): a pack's criteria from the success criteria they map to.

    ``crosswalk``: id, sc; ``applies``: id, pattern (rules that can fail a criterion; criteria without
    rows take all findings of their success criteria); ``overrides``: rule_id, advisory.
    NC over a real C over manual over inapplicable.
    """
    adjusted = findings.join(overrides.select("rule_id", F.col("advisory").alias("o")), "rule_id", "left").withColumn("advisory", F.coalesce("o", "advisory")).drop("o")
    limited = applies.select("id").distinct().withColumn("limited", F.lit(True))
    pairs = crosswalk.join(adjusted.select("sc", "rule_id", "advisory"), "sc").join(limited, "id", "left")
    free = pairs.where("limited is null").select("id", "advisory")
    gated = pairs.where("limited").join(applies, "id").where(rule_matches(F.col("rule_id"), F.col("pattern"))).select("id", "sc", "rule_id", "advisory")
    hits = free.unionByName(gated.select("id", "advisory")).groupBy("id").agg(F.count_if(~F.col("advisory")).alias("normative"))
    base = crosswalk.join(criteria.select("sc", "status", "inapplicable"), "sc").groupBy("id").agg(
        F.bool_or(F.col("status") == "NC").alias("nc"), F.bool_or((F.col("status") == "C") & ~F.col("inapplicable")).alias("c"), F.bool_or(F.col("status") == "manual").alias("m")
    )
    rows = crosswalk.select("id").distinct().join(base, "id", "left").join(hits, "id", "left").join(limited, "id", "left")
    n = F.coalesce("normative", F.lit(0))
    open_ = F.when(F.coalesce("c", F.lit(False)), "C").when(F.coalesce("m", F.lit(False)), "manual").otherwise("NA")
    status = F.when(n > 0, "NC").when(F.coalesce("nc", F.lit(False)), "manual").otherwise(open_)
    return rows.select("id", status.alias("status"), n.alias("normative"))


def results(
    pack: DataFrame, criteria: DataFrame, findings: DataFrame, overrides: DataFrame, outside: DataFrame, contracts: DataFrame, secondary: DataFrame,
    absent: DataFrame, seen: DataFrame, measured: DataFrame, adjudicated: DataFrame, documents: DataFrame | None = None,
) -> DataFrame:
    """(id, theme, status, inapplicable, normative, candidates, decided_by): every criterion of a standards pack, rung by rung.

    1. Nothing that it maps to can be audited, and the pack brings no rule of its own: open.
    2. A normative finding of its rules: failed. Where a contract says what its rules prove, only decisive ones count, and candidates are counted apart.
    3. Its own subject is absent: conforming without object. A success criterion failed, by rules that are not its own: open.
    4. Otherwise what its success criteria say: failed over truly conforming over open over without object, the last not where its own subject was seen.
    5. Conforming is no answer to a judged criterion, nor where the contract says that silence proves nothing: open.
    6. Enabled secondary mappings fail it by rules of other criteria. 7. What is open conforms where all of its rules that ran ran on every page.
    8. A recorded verdict decides; one that leaves it open opens all but a failure.

    ``pack``: id, theme, wcag, patterns (null: takes all findings), own_rules, judgment, silent (null: no contract); ``contracts``: id, seq,
    pattern, effect; ``outside``: sc that are not audited; ``secondary``: id, rule_id; ``absent`` and ``seen``: id; ``measured``: rule_id,
    everywhere; ``adjudicated``: id, status, decided_by; ``documents``: rule_id, advisory of downloadable documents.

    Findings are summed by (sc, rule) before they meet criteria, so the joins are of the sizes of the pack and the catalogue.
    """
    yes, no = F.lit(True), F.lit(False)
    base = pack.select("id", "theme", "patterns", F.coalesce("own_rules", no).alias("own_rules"), F.coalesce("judgment", no).alias("judgment"), F.col("silent"), F.array_distinct("wcag").alias("wcag"))
    maps = base.select("id", "patterns", "silent", F.explode("wcag").alias("sc"))
    told = maps.join(criteria.select("sc", "status", "inapplicable"), "sc", "left").join(outside.select("sc", yes.alias("out")).distinct(), "sc", "left")
    said = lambda s: F.coalesce(F.bool_or(F.col("status") == s), no)
    facts = told.groupBy("id").agg(
        F.count("status").alias("held"), said("NC").alias("nc"), said("manual").alias("open"), F.coalesce(F.bool_or((F.col("status") == "C") & ~F.col("inapplicable")), no).alias("c"),
        F.coalesce(F.bool_and(F.col("inapplicable")), yes).alias("idle"), F.bool_and(F.coalesce("out", no)).alias("out"),
    )
    # Findings by rule, then by criterion.
    sums = findings.groupBy("sc", "rule_id", "advisory").agg(F.count(F.lit(1)).alias("n"))
    changed = overrides.select("rule_id", F.col("advisory").alias("o"))
    ruled = sums.join(changed, "rule_id", "left").select("sc", "rule_id", F.coalesce("o", "advisory").alias("advisory"), "n")
    own = F.col("patterns").isNull() | F.exists("patterns", lambda p: rule_matches(F.col("rule_id"), p))
    pairs = maps.join(ruled, "sc").where(own).select("id", "silent", "patterns", "rule_id", "advisory", "n")
    if documents is not None:
        files = documents.groupBy("rule_id", "advisory").agg(F.count(F.lit(1)).alias("n")).join(changed, "rule_id", "left").select("rule_id", F.coalesce("o", "advisory").alias("advisory"), "n")
        gated = base.where(F.col("patterns").isNotNull())
        pairs = pairs.unionByName(gated.join(F.broadcast(files), F.exists("patterns", lambda p: rule_matches(F.col("rule_id"), p))).select("id", "silent", "patterns", "rule_id", "advisory", "n"))  # one row per document rule
    pairs = pairs.groupBy("id", "silent", "patterns", "rule_id", "advisory").agg(F.sum("n").alias("n"))
    effect = pairs.join(contracts, "id").where(rule_matches(F.col("rule_id"), F.col("pattern"))).groupBy("id", "rule_id", "advisory").agg(F.min_by("effect", "seq").alias("effect"))
    pairs = pairs.join(effect, ["id", "rule_id", "advisory"], "left")
    bound = F.col("silent").isNotNull()
    decisive = ~F.col("advisory") & (~bound | F.coalesce(F.col("effect") == "decisive-nc", no))
    hits = pairs.where(F.col("patterns").isNotNull()).groupBy("id").agg(F.sum(F.when(decisive, F.col("n")).otherwise(0)).alias("normative"), F.sum(F.when(bound & ~F.col("advisory") & F.coalesce(F.col("effect") == "candidate", no), F.col("n")).otherwise(0)).alias("candidates"))
    # The rungs.
    flag = lambda t, name: t.select("id").distinct().withColumn(name, yes)
    ran = measured.groupBy().agg(F.collect_set("rule_id").alias("ran"), F.collect_set(F.when(F.col("everywhere"), F.col("rule_id"))).alias("everywhere"))  # the rules of the catalogue
    foreign = secondary.join(findings.where(~F.col("advisory")).select("rule_id").distinct(), "rule_id", "left_semi")
    rows = base.join(facts, "id", "left").join(hits, "id", "left").join(flag(absent, "absent"), "id", "left").join(flag(seen, "seen"), "id", "left").join(flag(foreign, "foreign"), "id", "left")
    rows = rows.join(adjudicated.select("id", F.col("status").alias("ruled"), F.col("decided_by").alias("by")), "id", "left").crossJoin(F.broadcast(ran))  # one row
    is_ = lambda name: F.coalesce(F.col(name), no)
    number = lambda name: F.coalesce(F.col(name), F.lit(0))
    free, none_held = F.col("patterns").isNull(), number("held") == 0
    unaudited = F.coalesce(F.col("out"), yes) & ~F.col("own_rules")
    summed = F.when(is_("nc"), "NC").when(is_("c"), "C").when(is_("open"), "manual").otherwise("C")
    idle = none_held | F.coalesce(F.col("idle"), yes)
    empty = (summed == "C") & idle
    state = lambda s, gone=no: F.struct(s.alias("status") if isinstance(s, Column) else F.lit(s).alias("status"), gone.alias("gone"))
    first = (
        F.when(unaudited, state("manual"))
        .when(free & (summed == "manual") & is_("absent"), state("C", yes))
        .when(free, state(summed, empty))
        .when(number("normative") > 0, state("NC"))
        .when(is_("absent"), state("C", yes))
        .when(is_("nc"), state("manual"))
        .when(none_held & F.col("own_rules"), state("manual"))
        .when(empty & is_("seen"), state("manual"))
        .otherwise(state(summed, empty))
    )
    rows = rows.withColumn("s", first).withColumn("unproven", F.col("silent").isNotNull() & ~is_("silent"))
    guarded = (F.col("judgment") | F.col("unproven")) & (F.col("s.status") == "C") & ~F.col("s.gone")
    rows = rows.withColumn("s", F.when(is_("foreign"), state("NC")).when(guarded, state("manual")).otherwise(F.col("s")))
    here = F.array_intersect("patterns", "ran")
    wild = F.exists("patterns", lambda p: (p == "*") | p.rlike("[:-]\\*$"))
    proven = F.coalesce(~wild & (F.size(here) > 0) & (F.size(F.array_except(here, F.col("everywhere"))) == 0), no)
    rescued = (F.col("s.status") == "manual") & ~F.col("judgment") & ~unaudited & ~F.col("unproven") & proven
    rows = rows.withColumn("rescued", rescued).withColumn("s", F.when(rescued, state("C")).otherwise(F.col("s")))
    ruled_ = F.col("ruled")
    last = (
        F.when((ruled_ == "manual") & (F.col("s.status") == "NC"), state("NC"))
        .when(ruled_ == "manual", state("manual"))
        .when(ruled_ == "NA", state("C", yes))
        .when(ruled_.isNotNull(), state(ruled_))
        .otherwise(F.col("s"))
    )
    rows = rows.withColumn("s", last)
    by = F.when(ruled_.isNotNull(), F.col("by")).when(F.col("rescued"), "scan")
    return rows.select("id", "theme", F.col("s.status").alias("status"), F.col("s.gone").alias("inapplicable"), number("normative").cast("long").alias("normative"), number("candidates").cast("long").alias("candidates"), by.alias("decided_by"))
