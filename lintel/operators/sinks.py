"""Machine-readable and readable outputs of findings and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.operators.verdicts import dotted, rank


def sarif_results(located: DataFrame) -> DataFrame:
    """One row per SARIF result: rule_id, rule_index, level, page_id, line, col, fingerprint.

    Rules are numbered by their first appearance in the reading order of the whole log; a repeated fingerprint gets #n.
    """
    place = F.struct("page_id", "line", "col", rank(F.col("severity")).alias("worst"), "rule_id")
    seen = located.groupBy("rule_id").agg(F.min(place).alias("first"))  # one row per rule
    numbered = seen.select("rule_id", (F.row_number().over(Window.orderBy("first")) - 1).alias("rule_index"))
    nth = F.row_number().over(Window.partitionBy("finding_id").orderBy("ord"))
    level = F.when(F.col("advisory"), "note").when(F.col("severity") == "bloquant", "error").otherwise("warning")
    rows = located.withColumn("n", nth).join(F.broadcast(numbered), "rule_id")
    mark = F.when(F.col("n") == 1, F.col("finding_id")).otherwise(F.concat_ws("#", "finding_id", "n"))
    return rows.select("rule_id", "rule_index", level.alias("level"), "page_id", "line", "col", mark.alias("fingerprint"))


def ordered(located: DataFrame) -> DataFrame:
    """Reading order of findings within a page."""
    return located.orderBy("page_id", "line", "col", rank(F.col("severity")), "rule_id")


def write_findings(located: DataFrame, path: str, form: str = "parquet") -> None:
    """Findings as parquet, json or csv, partitioned by rule."""
    located.write.mode("overwrite").partitionBy("rule_id").format(form).save(path)


def write_document(folder: str, criteria: DataFrame, findings: DataFrame, pages: DataFrame) -> None:
    """An audit as three folders of JSON lines: criteria in numeric order, findings and pages as they are distributed."""
    criteria.orderBy(dotted(F.col("sc"))).coalesce(1).write.mode("overwrite").json(f"{folder}/criteria")  # at most the criteria of a standard
    findings.write.mode("overwrite").json(f"{folder}/findings")
    pages.write.mode("overwrite").json(f"{folder}/pages")


def baseline_counts(located: DataFrame) -> DataFrame:
    """(page_id, key, n): what a later run is compared with by ``changes.surplus``."""
    from lintel.operators.changes import regression_key

    return located.groupBy("page_id", regression_key(F.col("rule_id"), F.col("sc"), F.col("selector")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def ledger_entries(verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(sc, verdict, anchors, fingerprint): decided verdicts with the evidence they were decided on, as ``changes.replayed`` reads them."""
    from lintel.operators.changes import fingerprint

    keys = evidence.groupBy("sc").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # a criterion's evidence classes, capped by the worklist
    rows = verdicts.where(F.col("verdict").isin("C", "NC", "NA")).join(keys, "sc", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    return rows.select("sc", "verdict", F.transform("keys", lambda k: F.left(F.sha2(k.cast("binary"), 256), F.lit(16))).alias("anchors"), fingerprint(F.col("keys")).alias("fingerprint"))


def new_tickets(tickets: DataFrame, existing: DataFrame) -> DataFrame:
    """Tickets whose title is not taken yet."""
    return tickets.join(existing.select("title").distinct(), "title", "left_anti")


def backlog(units: DataFrame) -> DataFrame:
    """Work items in the order of doing them: worst severity, then most points, then criterion."""
    return units.orderBy(rank(F.col("severity")), F.desc("points"), dotted(F.col("sc")))


def comment(located: DataFrame, changes: DataFrame, most: int = 20) -> str:
    """A Markdown comment on a change: counts, and the ``most`` most severe new findings (the cap is the feature)."""
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}  # new, fixed
    new = changes.where("change = 'new'").select("finding_id").distinct()
    top = located.join(new, "finding_id", "left_semi").orderBy(rank(F.col("severity")), "rule_id", "page_id", "line", "col").limit(most).collect()
    lines = [f"{counts.get('new', 0)} new, {counts.get('fixed', 0)} fixed", ""]
    return "\n".join([*lines, *(f"- {r['severity']} `{r['rule_id']}` {r['page_id']}:{r['line']}:{r['col']}" for r in top)])


def markdown_grid(grid: DataFrame, title: str) -> str:
    """A criterion-by-page grid (bounded by its pivot list) as a Markdown table."""
    rows = grid.orderBy(dotted(F.col("sc"))).collect()
    head = ["criterion", *grid.columns[1:]]
    lines = [f"## {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
