"""Which files a source file uses: imports, re-exports, style imports and page resources, resolved to known files.

Statements are found by patterns over the text without comments; imports of types alone are erased, as compilers do. A
specifier becomes a path (relative, absolute or through an alias), its dot segments are resolved, and the paths that it may stand for are ranked
candidates; the first that is a known file wins. Packages, schemes and fragments resolve to nothing.

Scale: candidates are made once per distinct path, not per statement, and meet the known files in an equi join; statements meet
their resolution by :func:`lintel.operators.skew.lookup`, so that a module which everything imports is no hot key.

Edge cases: null sources have no statements; a path that leaves the root keeps its leading dots and is no known file; repeated files count
once; a file that names itself is an edge to itself; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators.skew import lookup
from lintel.plans.storage import materialize

#: How modules and style sheets name what they use.
IMPORT = r"""\bimport\s+(type\s+)?([^;'"`]*?)\s*\bfrom\s*(["'])([^"'\n]+)\3"""
REEXPORT = r"""\bexport\s+(type\s+)?(\*\s*(?:as\s+[\w$]+)?|\{[^}]*\})\s*from\s*(["'])([^"'\n]+)\3"""
SIDE_EFFECT = r"""\bimport\s*(["'])([^"'\n]+)\1"""
DYNAMIC = r"""\b(?:import|require)\s*\(\s*(["'`])([^"'`\n]+)\1\s*\)"""
STYLE = r"""@(?:import|use|forward)\s+(?:url\(\s*)?(["'])([^"'\n]+)\1"""
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
LINE_COMMENT = r"(?m)^\s*//.*$"
#: Resources of a page.
RESOURCE = r"""(?i)<(?:script|link|img|iframe|source|a)\b[^>]*?\s(?:src|href)\s*=\s*(["'])([^"']+)\1"""
STYLES = (".css", ".scss", ".sass", ".less")
MARKUP = (".html", ".htm", ".xhtml")
SCRIPTS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro", ".json")


def _ends(path: Column, endings: tuple[str, ...]) -> Column:
    return F.lower(path).rlike("(?:" + "|".join(e.replace(".", "[.]") for e in endings) + ")$")


def _found(text: Column, pattern: str, group: int, kind: str) -> Column:
    """Targets of all matches of a pattern."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.transform(matches, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))


def _named(text: Column, pattern: str, kind: str) -> Column:
    """Targets of statements that take something but types."""
    part = lambda s, n: F.regexp_extract(s, pattern, n)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.struct(F.lit(kind).alias("kind"), part(s, 4).alias("target"), part(s, 1).alias("type"), F.trim(part(s, 2)).alias("clause")))

    def values(clause: Column) -> Column:
        listed = F.split(F.regexp_replace(clause, "^\\{|\\}$", ""), ",")
        return ~clause.rlike("(?s)^\\{.*\\}$") | F.exists(listed, lambda n: (F.trim(n) != "") & ~F.trim(n).rlike("^type\\s"))

    kept = F.filter(matches, lambda m: (m["type"] == "") & (m["clause"] != "") & values(m["clause"]))
    return F.transform(kept, lambda m: F.struct(m["kind"].alias("kind"), m["target"].alias("target")))


def statements(files: DataFrame) -> DataFrame:
    """(file, kind, target): what each of ``files`` (file, source) says that it uses; distinct."""
    path, text = F.col("file"), F.regexp_replace("source", BLOCK_COMMENT, "")
    code = F.regexp_replace(text, LINE_COMMENT, "")
    script = F.concat(_named(code, IMPORT, "import"), _named(code, REEXPORT, "export"), _found(code, SIDE_EFFECT, 2, "side-effect"), _found(code, DYNAMIC, 2, "dynamic"))
    page = _found(F.regexp_replace("source", "(?s)<!--.*?-->", ""), RESOURCE, 2, "resource")
    said = F.when(_ends(path, STYLES), _found(text, STYLE, 2, "style")).when(_ends(path, MARKUP), page).otherwise(script)
    return files.select("file", F.explode(said).alias("s")).select("file", "s.*").distinct()


def plain_path(path: Column) -> Column:
    """A path without dot segments and doubled or leading slashes; what leads out of the root keeps its dots."""

    def step(held: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(held) > 0) & (F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit("")) != "..")
        return F.when(part.isin("", "."), held).when(up, F.slice(held, 1, F.size(held) - 1)).otherwise(F.concat(held, F.array(part)))

    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def _candidates(base: Column, style: Column) -> Column:
    """The files that a path may stand for, best first."""
    folder, name = _folder(base), F.regexp_extract(base, "([^/]*)$", 1)
    scripts = F.array(base, *[F.concat(base, F.lit(e)) for e in SCRIPTS], *[F.concat(base, F.lit(f"/index{e}")) for e in SCRIPTS])
    styles = [base]
    for e in (".scss", ".sass", ".css", ".less"):
        styles += [F.concat(base, F.lit(e)), F.concat(folder, F.lit("_"), name, F.lit(e)), F.concat(base, F.lit(f"/_index{e}")), F.concat(base, F.lit(f"/index{e}"))]
    return F.when(style, F.array(*styles)).otherwise(scripts)


def resolved(said: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(file, kind, target, dst): statements and the known file each stands for, null where there is none.

    ``aliases`` maps prefixes of specifiers to paths from the root, longest first.
    """
    spec = F.split("target", "[?]")[0]
    spec = F.when(F.col("kind") == "resource", F.split(spec, "#")[0]).otherwise(spec)
    style, outside = _ends(F.col("file"), STYLES), (spec == "") | spec.rlike("^(?i)(?:[a-z]+:|//|#)")
    base = F.when(outside | (style & spec.startswith("~")), F.lit(None).cast("string"))
    for prefix in sorted(aliases or {}, key=len, reverse=True):
        base = base.when(~style & spec.startswith(prefix), F.concat(F.lit(aliases[prefix]), F.substring(spec, len(prefix) + 1, 1 << 20)))
    base = base.when(spec.startswith("/"), spec).when(style | spec.startswith(".") | (F.col("kind") == "resource"), F.concat(_folder(F.col("file")), spec))
    rows = materialize(said.select("file", "kind", "target", F.concat(F.when(style, "s:").otherwise("m:"), plain_path(base)).alias("base")), "statements")
    tried = rows.where(F.col("base").isNotNull()).select("base").distinct()
    tried = tried.select("base", F.posexplode(_candidates(F.substring("base", 3, 1 << 20), F.col("base").startswith("s:"))).alias("rank", "dst"))
    known = files.select(plain_path(F.col("file")).alias("dst")).distinct()
    hits = tried.join(known, "dst").groupBy("base").agg(F.min_by("dst", "rank").alias("dst"))
    return lookup(rows, materialize(hits, "resolved"), "base").select("file", "kind", "target", "dst")


def edges(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(src, dst): distinct edges between known files."""
    rows = resolved(statements(files), files, aliases).where(F.col("dst").isNotNull())
    return rows.select(plain_path(F.col("file")).alias("src"), "dst").distinct()
