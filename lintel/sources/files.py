"""Files as pages: expansion of inputs, scope filters and tiers, all on file metadata before any read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Markup extensions, and names of test artefacts.
EXTENSIONS = ("html", "htm", "xhtml", "jsx", "tsx", "vue", "svelte", "astro")
TESTS = r"(^|/)(__tests__|__mocks__|test|tests|e2e|cypress)/|\.(test|spec|stories|story)\.[a-z]+$"


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression; ** crosses folders."""
    out = ""
    i = 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"(?:^|/){out}$"


def in_scope(path: Column, include: list[str] | None = None, exclude: list[str] | None = None, tests: bool = False) -> Column:
    keep = path.rlike(rf"(?i)\.({'|'.join(EXTENSIONS)})$")
    if include:
        keep = keep & path.rlike("|".join(map(glob_pattern, include)))
    if exclude:
        keep = keep & ~path.rlike("|".join(map(glob_pattern, exclude)))
    return keep if tests else keep & ~path.rlike(TESTS)


def kind_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("vue", "svelte", "astro"), "sfc").when(ext.isin("jsx", "tsx"), "jsx").otherwise("html")


def read_pages(spark: SparkSession, *paths: str, **scope) -> DataFrame:
    """(page_id, url, html, kind) of markup files below the paths, filtered before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    rows = files.where(in_scope(F.col("path"), **scope))
    return rows.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"), kind_of(F.col("path")).alias("kind"))


def without_front_matter(source: Column) -> Column:
    """A component source whose fenced head (between two lines of three dashes) is blanked; lines keep their numbers."""
    fence = "(?s)^(\\s*---[ \\t]*\\r?\\n.*?\\n---[ \\t]*(?:\\r?\\n|$))"
    head = F.regexp_extract(source, fence, 1)
    blank = F.regexp_replace(head, "[^\\r\\n]", " ")
    return F.when(head == "", source).otherwise(F.concat(blank, F.substring(source, F.length(head) + 1, F.length(source))))


def readable(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, kind) as far as the markup parser reads them.

    Single-file components are templates in markup: they are read whole, Astro's head blanked. JSX is not read.
    """
    astro = F.lower(F.col("url")).endswith(".astro")
    return pages.where("kind in ('html', 'sfc')").withColumn("html", F.when(astro, without_front_matter(F.col("html"))).otherwise(F.col("html")))


def from_text(spark: SparkSession, text: str, name: str = "stdin") -> DataFrame:
    """One page given as a string, such as standard input, as a table of one row."""
    rows = spark.createDataFrame([(name, text)], "url string, html string")
    return rows.select(F.xxhash64("url").alias("page_id"), "url", "html", F.lit("html").alias("kind"))


def pdf_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, sha1, bytes, content) of the PDF files below the paths, each content once, its first path kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(list(paths))
    first = files.select(F.sha1("content").alias("sha1"), "path").groupBy("sha1").agg(F.min("path").alias("path"))
    return files.join(first, "path").select(F.col("path").alias("file"), "sha1", F.col("length").alias("bytes"), "content")


def changed_only(pages: DataFrame, changed: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose path ends in one of the changed files (file: paths from the root of a repository).

    Suffixes of the pages' paths are exploded, so the match is an equi join.
    """
    from lintel.operators.graph import suffixes

    keys = pages.select(F.col(url).alias("_url"), F.explode(suffixes(F.col(url))).alias("_key"))
    hit = keys.join(changed.select(F.regexp_replace("file", "^[.]/", "").alias("_key")).distinct(), "_key").select("_url").distinct()
    return pages.join(hit, F.col(url) == F.col("_url"), "left_semi")


def tiered(files: DataFrame, path: str = "url") -> DataFrame:
    """Distinct files with the tier that orders them: pages and layouts, then components, then the rest."""
    p = F.col(path)
    tier = F.when(p.rlike(r"(?i)(^|/)(pages?|layouts?|routes|app)/|index\.[a-z]+$"), 0).when(p.rlike(r"(?i)(^|/)components?/"), 1).otherwise(2)
    return files.dropDuplicates([path]).withColumn("tier", tier)
