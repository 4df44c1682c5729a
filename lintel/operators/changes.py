"""Set operators over findings: baselines, regressions, duplicates, merges and review passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_sources(files: DataFrame, key: str, order: str, squeeze: bool = False) -> DataFrame:
    """The first file of each content; ``squeeze`` compares up to white space. Files without an order come first.

    The first of each content is a partial aggregate over (digest, order): copies never meet in one task,
    and contents move only for the files that stay.
    """
    text = F.coalesce(F.col(key), F.lit(""))
    text = F.trim(F.regexp_replace(text, "\\s+", " ")) if squeeze else text
    digest = F.sha1(text.cast("binary"))
    place = F.struct(F.col(order).isNotNull().alias("given"), F.col(order).alias("at"))
    first = files.select(digest.alias("_digest"), place.alias("_place")).groupBy("_digest").agg(F.min("_place").alias("_place"))
    first = first.select(F.col("_digest").alias("_d"), F.col("_place.at").alias("_at"))
    held = files.withColumn("_digest", digest).join(first, (F.col("_digest") == F.col("_d")) & F.col(order).eqNullSafe(F.col("_at")))
    return held.dropDuplicates(["_digest"]).drop("_digest", "_d", "_at")


def against_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """finding_id, change (new or fixed): fixed counts only where the file was read again."""
    new = current.join(baseline.select("finding_id").distinct(), "finding_id", "left_anti").select("finding_id", F.lit("new").alias("change"))
    again = baseline.join(current.select("page_id").distinct(), "page_id", "left_semi")
    fixed = again.join(current.select("finding_id").distinct(), "finding_id", "left_anti").select("finding_id", F.lit("fixed").alias("change"))
    return new.unionByName(fixed)


def plain_selector(selector: Column) -> Column:
    """A selector with generated parts folded away: ids of components, hash-like tokens, digits."""
    s = F.lower(F.trim(selector))
    head = F.regexp_extract(s, "^([^#.\\[:\\s>]*)", 1)
    rest = F.substring(s, F.length(head) + 1, 1 << 20)
    rest = F.regexp_replace(rest, ":r[0-9a-z]+:|«r[0-9a-z]+»|_r_[0-9a-z]+_", ":r:")
    # Tokens of five characters or more that mix letters and digits.
    rest = F.regexp_replace(rest, "(?<![a-z0-9])(?=[a-z0-9]{5,}(?![a-z0-9]))(?=[a-z0-9]*[0-9])(?=[a-z0-9]*[a-z])[a-z0-9]+", "~")
    return F.concat(head, F.regexp_replace(rest, "[0-9]+", "0"))


def regression_key(rule: Column, sc: Column, selector: Column) -> Column:
    return F.concat_ws("|", rule, sc, plain_selector(selector))


def surplus(current: DataFrame, baseline_counts: DataFrame) -> DataFrame:
    """Occurrences beyond what the baseline held, per (page, key): a multiset difference.

    ``current`` has page_id, key and ord; ``baseline_counts`` page_id, key, n. Pages that the
    baseline does not know are reported as unbaselined.
    """
    known = baseline_counts.select("page_id").distinct().withColumn("known", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("page_id", "key").orderBy("ord"))
    rows = current.withColumn("nth", nth).join(baseline_counts, ["page_id", "key"], "left").join(known, "page_id", "left")
    state = F.when(F.col("known").isNull(), "unbaselined").when(F.col("nth") > F.coalesce("n", F.lit(0)), "new")
    return rows.withColumn("state", state).where("state is not null").select("page_id", "key", "ord", "state")


def vanished(current: DataFrame, baseline_counts: DataFrame) -> DataFrame:
    """(page_id, fixed): occurrences the baseline had and the pages read now lack."""
    now = current.groupBy("page_id", "key").agg(F.count(F.lit(1)).alias("now"))
    pages = current.select("page_id").distinct()
    rows = baseline_counts.join(pages, "page_id", "left_semi").join(now, ["page_id", "key"], "left")
    return rows.groupBy("page_id").agg(F.sum(F.greatest(F.col("n") - F.coalesce("now", F.lit(0)), F.lit(0))).alias("fixed"))


def union_of(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sets of findings merged by identity; the first wins."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    keep = F.row_number().over(Window.partitionBy("finding_id").orderBy("_o"))
    return both.withColumn("_n", keep).where("_n = 1").drop("_n", "_o")


def shared_coverage(coverage: DataFrame) -> DataFrame:
    """(kind, key, anywhere, everywhere): union, and relational division by all pages."""
    pages = coverage.select("page_id").distinct().agg(F.count(F.lit(1)).alias("pages"))
    seen = coverage.groupBy("kind", "key").agg(F.count_distinct("page_id").alias("n"))
    return seen.crossJoin(F.broadcast(pages)).select("kind", "key", F.lit(True).alias("anywhere"), (F.col("n") == F.col("pages")).alias("everywhere"))  # pages is one row


def fingerprint(keys: Column) -> Column:
    """Order-free digest of a list of evidence keys."""
    body = F.concat_ws("\n", F.concat(F.size(keys).cast("string")), F.array_join(F.array_sort(keys), "\n"))
    return F.concat(F.lit("sha256:"), F.left(F.sha2(body.cast("binary"), 256), F.lit(32)))


def replayed(ledger: DataFrame, evidence: DataFrame, open_criteria: DataFrame, complete: bool = True) -> DataFrame:
    """(sc, state): fresh, stale, obsolete or missing for every open or recorded criterion.

    ``ledger``: sc, verdict, anchors array, fingerprint; ``evidence``: sc, key. A non-conformity
    survives new evidence; a conformity covers subsets of what was read, but never nothing.
    """
    keys = evidence.groupBy("sc").agg(F.collect_list("key").alias("keys"))
    hashes = F.transform(F.coalesce("keys", F.array().cast("array<string>")), lambda k: F.left(F.sha2(k.cast("binary"), 256), F.lit(16)))
    rows = ledger.join(open_criteria.select("sc", F.lit(True).alias("open")).distinct(), "sc", "full_outer").join(keys, "sc", "left")
    added = F.size(F.array_except(hashes, F.coalesce("anchors", F.array().cast("array<string>")))) > 0
    state = (
        F.when(F.col("open").isNull(), "obsolete")
        .when(F.col("verdict").isNull(), "missing")
        .when(F.lit(not complete), "stale")
        .when(fingerprint(F.coalesce("keys", F.array().cast("array<string>"))) == F.col("fingerprint"), "fresh")
        .when(F.size(F.coalesce("anchors", F.array().cast("array<string>"))) == 0, "stale")
        .when(F.col("verdict") == "NC", "fresh")
        .when(F.size(F.coalesce("keys", F.array().cast("array<string>"))) == 0, "stale")
        .when(added, "stale")
        .otherwise("fresh")
    )
    return rows.select("sc", state.alias("state"))


def merged_ledger(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert by criterion: fresh entries win."""
    return fresh.unionByName(old.join(fresh.select("sc").distinct(), "sc", "left_anti"))


def verdict_counts(items: DataFrame) -> DataFrame:
    """One row: how many reviewed items are supported, partial, refuted, unsupported, invalid or missing."""
    v = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    known = ("supported", "partial", "refuted", "unsupported")
    return items.agg(*[F.count_if(v == k).alias(k) for k in known], F.count_if((v != "") & ~v.isin(*known)).alias("invalid"), F.count_if(v == "").alias("missing"))


def contract_violations(verdicts: DataFrame, open_criteria: DataFrame) -> DataFrame:
    """(sc, violation) of a verdict file: each check is one query, united.

    ``verdicts``: sc, verdict, justification, decided_by, auditor, citations int, findings int, reason.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    state = lambda cond, name: verdicts.where(cond).select("sc", F.lit(name).alias("violation"))
    checks = [
        verdicts.groupBy("sc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sc", F.lit("duplicate").alias("violation")),
        open_criteria.join(verdicts, "sc", "left_anti").select("sc", F.lit("missing").alias("violation")),
        verdicts.join(open_criteria, "sc", "left_anti").select("sc", F.lit("not-open").alias("violation")),
        state(~F.coalesce(F.col("decided_by").isin("agent", "human"), F.lit(False)), "decided-by"),
        state((F.col("decided_by") == "human") & blank("auditor"), "auditor"),
        state(F.col("verdict").isNull(), "no-verdict"),
        state(F.col("verdict").isNotNull() & ~F.col("verdict").isin("C", "NC", "NA", "manual"), "unknown-verdict"),
        state(F.col("verdict").isin("C", "NA") & blank("justification"), "justification"),
        state((F.col("verdict") == "C") & (F.coalesce("citations", F.lit(0)) == 0), "citation"),
        state((F.col("verdict") == "NC") & (F.coalesce("findings", F.lit(0)) == 0), "finding"),
        state((F.col("verdict") == "manual") & blank("reason"), "reason"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.distinct()


def scored_corpus(cases: DataFrame, reported: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per rule of a test corpus: failed, caught, clean, false_positives, verdict.

    ``cases``: rule, testcase, expected; ``reported``: testcase, engine_rule; ``mapping``: rule, engine_rule.
    """
    hits = reported.join(mapping, "engine_rule").select("rule", "testcase").distinct().withColumn("hit", F.lit(True))
    rows = cases.join(hits, ["rule", "testcase"], "left").join(mapping.select("rule", F.lit(True).alias("mapped")).distinct(), "rule", "left")
    failed, hit = F.col("expected") == "failed", F.coalesce("hit", F.lit(False))
    out = rows.groupBy("rule").agg(
        F.count_if(failed).alias("failed"), F.count_if(failed & hit).alias("caught"), F.count_if(~failed).alias("clean"), F.count_if(~failed & hit).alias("false_positives"), F.max("mapped").alias("mapped")
    )
    verdict = F.when(F.col("mapped").isNull(), "not-scored").when(F.col("false_positives") > 0, "inconsistent").when(F.col("caught") < F.col("failed"), "partially-consistent").otherwise("consistent")
    return out.select("rule", "failed", "caught", "clean", "false_positives", verdict.alias("verdict"))


def applicable_edits(edits: DataFrame) -> DataFrame:
    """(file, start, end, replacement, state): edits from the back of a file; overlaps are conflicts.

    An edit is applied when it ends at or before the start of every edit applied behind it. Taken
    greedily from the back this equals comparing with the nearest applied start, which is found per
    file in one ordered pass.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("start")).alias("k"), (-F.col("end")).alias("k2"), F.col("start"), F.col("end"), F.col("replacement"))))
    empty = F.struct(F.lit(2**31 - 1).alias("last"), F.array().cast("array<int>").alias("inserted"), F.array().cast("array<struct<start:int,end:int,replacement:string,state:string>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        insertion = e["start"] == e["end"]
        bad = (e["end"] > acc["last"]) | (insertion & F.array_contains(acc["inserted"], e["start"]))
        row = F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement"), F.when(bad, "conflict").otherwise("applied").alias("state"))
        return F.struct(
            F.when(bad, acc["last"]).otherwise(e["start"]).alias("last"),
            F.when(~bad & insertion, F.concat(acc["inserted"], F.array(e["start"]))).otherwise(acc["inserted"]).alias("inserted"),
            F.concat(acc["out"], F.array(row)).alias("out"),
        )

    grouped = edits.groupBy("file").agg(ordered.alias("edits")).select("file", F.aggregate("edits", empty, step)["out"].alias("out"))
    return grouped.select("file", F.explode("out").alias("e")).select("file", "e.*")


def apply_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, output): the sources with their applicable edits made, back to front."""
    good = applicable_edits(edits).where("state = 'applied'")
    lists = good.groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-F.col("start")).alias("k"), (-F.col("end")).alias("k2"), "start", "end", "replacement"))).alias("edits"))
    done = F.aggregate("edits", F.col("source"), lambda s, e: F.concat(F.substring(s, F.lit(1), e["start"]), e["replacement"], F.substring(s, e["end"] + 1, F.lit(1 << 30))))
    return sources.join(lists, "file").select("file", done.alias("output"))
