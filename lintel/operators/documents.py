"""Rules over facts of PDF documents, one row per file.

``pdf_facts``: file, readable, tagged, lang, title, display_doc_title, pages, fonts, text_ops,
content_scanned, has_structure, headings, tables_without_th, figures, figures_without_alt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def pdf_findings(facts: DataFrame) -> DataFrame:
    """(file, rule_id, sc, severity, advisory, detail)."""
    spared = F.col("tagged") & F.col("has_structure") & (F.col("figures") > 0) & (F.col("figures_without_alt") == 0)
    shallow = F.col("tagged") & F.col("has_structure")
    checks = [
        (~F.col("tagged"), "pdf-untagged", "1.3.1", "majeur", False, ""),
        (_blank("lang"), "pdf-lang-missing", "3.1.1", "majeur", False, ""),
        (_blank("title"), "pdf-title-missing", "2.4.2", "majeur", False, "missing"),
        (~_blank("title") & ~F.col("display_doc_title"), "pdf-title-missing", "2.4.2", "mineur", False, "not-displayed"),
        (F.col("content_scanned") & (F.col("pages") > 0) & (F.col("text_ops") == 0) & (F.col("fonts") == 0) & ~spared, "pdf-no-text", "1.1.1", "bloquant", False, ""),
        (shallow & (F.col("headings") == 0), "pdf-structure-shallow", "1.3.1", "mineur", True, "no-heading"),
        (shallow & (F.col("tables_without_th") > 0), "pdf-structure-shallow", "1.3.1", "mineur", True, "table-no-th"),
    ]
    names = ("rule_id", "sc", "severity", "advisory", "detail")
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])) for cond, *values in checks]))
    return facts.where("readable").select("file", F.explode(hits).alias("f")).select("file", "f.*")


def pdf_outcomes(facts: DataFrame, found: DataFrame) -> DataFrame:
    """(file, rule_id, outcome): fail, not-detected, or not-checked where the file could not show it."""
    can = {
        "pdf-untagged": F.col("readable"), "pdf-lang-missing": F.col("readable"), "pdf-title-missing": F.col("readable"),
        "pdf-no-text": F.col("readable") & F.col("content_scanned") & (F.col("pages") > 0),
        "pdf-structure-shallow": F.col("readable") & F.col("tagged") & F.col("has_structure"),
    }
    pairs = F.array(*[F.struct(F.lit(r).alias("rule_id"), c.alias("can")) for r, c in can.items()])
    rows = facts.select("file", F.explode(pairs).alias("p")).select("file", "p.*")
    rows = rows.join(found.select("file", "rule_id", F.lit(True).alias("fired")).distinct(), ["file", "rule_id"], "left")
    return rows.select("file", "rule_id", F.when(F.col("fired"), "fail").when(F.col("can"), "not-detected").otherwise("not-checked").alias("outcome"))


def basic_pdf_facts(files: DataFrame) -> DataFrame:
    """Facts that a scan of the bytes settles, from a ``binaryFile`` source: markers in plain objects only."""
    body = F.decode(F.col("content"), "ISO-8859-1")
    count = lambda p: F.regexp_count(body, F.lit(p))
    return files.select(
        F.col("path").alias("file"), body.startswith("%PDF-").alias("readable"), (body.rlike("/MarkInfo") & body.rlike("/Marked\\s+true") & body.rlike("/StructTreeRoot")).alias("tagged"),
        F.regexp_extract(body, "/Lang\\s*\\(([^)]*)\\)", 1).alias("lang"), F.regexp_extract(body, "/Title\\s*\\(([^)]*)\\)", 1).alias("title"), body.rlike("/DisplayDocTitle\\s+true").alias("display_doc_title"),
        count("/Type\\s*/Page\\b").alias("pages"), count("/Type\\s*/Font\\b").alias("fonts"), count("\\bT[jJ]\\b").alias("text_ops"), (~body.rlike("/Filter")).alias("content_scanned"), body.rlike("/StructTreeRoot").alias("has_structure"),
        count("/S\\s*/H[1-6]?\\b").alias("headings"), F.greatest(count("/S\\s*/Table\\b") - count("/S\\s*/TH\\b"), F.lit(0)).alias("tables_without_th"),
        count("/S\\s*/Figure\\b").alias("figures"), F.greatest(count("/S\\s*/Figure\\b") - count("/Alt\\s*\\("), F.lit(0)).alias("figures_without_alt"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
