"""URL and page-identity columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions of files that a crawl treats as downloads.
DOWNLOADS = (
    "pdf docx? pptx? xlsx? odt ods odp rtf csv zip rar 7z gz tar epub dmg exe pkg mp3 mp4 m4a m4v avi mov wmv webm ogg wav png jpe?g gif svg webp avif ico woff2? ttf otf"
).split()


def path_of(url: Column) -> Column:
    """The path of an absolute URL, / when it is empty; other strings are their own path."""
    path = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    absolute = url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://")
    return F.when(absolute, F.when(path == "", "/").otherwise(path)).otherwise(url)


def origin_of(url: Column) -> Column:
    """scheme://host[:port] of an absolute URL, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)), F.lit(""))


def is_download(url: Column) -> Column:
    return path_of(url).rlike(f"(?i)\\.(?:{'|'.join(DOWNLOADS)})$")


def canonical(url: Column) -> Column:
    """Without fragment, without a directory's index file, with / for an empty path."""
    bare = F.regexp_replace(url, "#.*$", "")
    no_index = F.regexp_replace(bare, "(?i)^([a-z][a-z0-9+.-]*://[^/?]*(?:/[^?]*)?/)index\\.x?html?(\\?|$)", "$1$2")
    return F.regexp_replace(no_index, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)(\\?|$)", "$1/$2")


def fold(text: Column) -> Column:
    """Lower case without diacritics, for Latin letters (canonical decomposition of U+00C0..U+017F)."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0].lower()) for c in range(0xC0, 0x180) if unicodedata.normalize("NFD", chr(c))[0].isascii()]
    lowered = F.lower(F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)))
    return F.regexp_replace(lowered, "[\\u0300-\\u036f]", "")


def slug(url: Column) -> Column:
    """A page id from a URL path; the root is the home page."""
    path = path_of(url)
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(path, "\\+", "%2B")), path)
    dashed = F.regexp_replace(F.regexp_replace(fold(decoded), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(dashed != "", dashed).when(decoded.isin("/", ""), "accueil").otherwise("page")


def free_ids(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """``rows`` with unique ids in ``base``: the first of an id keeps it, the n-th gets -n or the next free number.

    A number is taken where another row's id already reads like id-number; the free numbers of an id are those
    that no such row holds, and its rows take them in order. All of it is joins and windows by id.
    """
    pattern = "^(.+)-([1-9][0-9]{0,8})$"
    given = rows.select(F.col(base).alias("_b")).distinct()
    read = given.select(F.regexp_extract("_b", pattern, 1).alias("_stem"), F.regexp_extract("_b", pattern, 2).try_cast("long").alias("_number"))
    taken = read.where("_number > 1").groupBy("_stem").agg(F.array_sort(F.collect_set("_number")).alias("_taken"))
    nth = F.row_number().over(Window.partitionBy(base).orderBy(*order)).cast("long")
    out = rows.withColumn("_n", nth).join(taken, F.col(base) == F.col("_stem"), "left")
    # The n-th row takes the n-th free number: one more for every taken number that is not above it.
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.col("_n"), lambda at, t: F.when(t <= at, at + 1).otherwise(at))
    return out.withColumn(base, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("-", base, free))).drop("_n", "_stem", "_taken")


def page_ids(pages: DataFrame, url: str = "url", order: str = "page_id") -> DataFrame:
    """Adds ``slug`` and a unique ``id`` made from it."""
    base = pages.withColumn("slug", slug(F.col(url)))
    return free_ids(base.withColumn("id", F.col("slug")), "id", [order])


def title_of(html: Column) -> Column:
    """The served title, entities decoded and white space collapsed; null without one."""
    raw = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    text = raw
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(text, "\\s+", " ")), F.lit(""))


def name_from(url: Column) -> Column:
    """A readable name from the last path segment."""
    last = F.try_element_at(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), F.lit(-1))
    words = F.trim(F.regexp_replace(F.regexp_replace(last, "(?i)\\.x?html?$", ""), "[-_]+", " "))
    return F.when(F.coalesce(words, F.lit("")) == "", "Accueil").otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20)))


def absolute(href: Column, base: Column) -> Column:
    """href resolved against base: absolute, protocol-relative, root-relative, query-only or relative."""
    origin = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = path_of(base)
    folder = F.regexp_replace(path, "[^/]*$", "")
    joined = F.concat(origin, folder, href)
    dots = F.regexp_replace(joined, "/\\./", "/")
    for _ in range(3):
        dots = F.regexp_replace(dots, "(?<=[^/:])/[^/]+/\\.\\./", "/")
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .otherwise(dots)
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, target): distinct same-origin links of the served markup that are no downloads."""
    found = F.regexp_extract_all(F.col("html"), F.lit("(?i)<a\\b[^>]*\\bhref\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    rows = pages.select("page_id", "url", F.explode(F.array_distinct(found)).alias("href")).withColumn("href", F.trim("href"))
    rows = rows.where((F.col("href") != "") & ~F.col("href").startswith("#")).withColumn("target", F.regexp_replace(absolute(F.col("href"), F.col("url")), "#.*$", ""))
    same = F.col("target").rlike("^https?:") & (origin_of(F.col("target")) == origin_of(F.col("url"))) & ~is_download(F.col("target"))
    return rows.where(same).select("page_id", "url", canonical(F.col("target")).alias("target")).distinct()


def sitemap_urls(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit("(?i)<loc>\\s*([^<]+?)\\s*</loc>"), F.lit(1))
