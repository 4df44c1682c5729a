"""Named queries over the tables, and the SQL each of them is held against.

Queries over ``pages`` and ``documents`` have an independent SQL form. Queries that need DOM
nesting, signals or verdict state also run over small fixtures written here; for those rows the
SQL states the expected result. Page ids of fixtures are negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import urls
from lintel.functions import vocabulary as V
from lintel.operators import changes, documents, graph, harvest, packs, rules, signals, sinks, verdicts
from lintel.plans import attribution_queries, content_queries, contract_queries, module_queries, review_queries, state_queries, subject_queries  # noqa: F401
from lintel.plans.made_pages import APPLIES, EVIDENCE, MADE, SUBJECT_COUNTS
from lintel.plans.registry import ORACLES, QUERIES, Query, query, values
from lintel.plans.seeds import SEEDS
from lintel.plans.storage import materialize, table
from lintel.sources.html import STANDARD, elements

# --- one query per rule: all pages, the rule's seeds, and pages made from the rows of a table

_FOUND = "page_id BIGINT, sc VARCHAR, severity VARCHAR, advisory BOOLEAN, msg_id VARCHAR, n BIGINT"
#: Rules that fire on generated pages, as SQL over their markup.
ON_PAGES = {
    "missing-main-landmark": "SELECT page_id, '1.3.1' AS sc, 'majeur' AS severity, FALSE AS advisory, 'missing-main-landmark' AS msg_id, CAST(1 AS BIGINT) AS n FROM pages WHERE html NOT LIKE '%<main%' AND html NOT LIKE '%role=\"main\"%' AND NOT regexp_matches(html, '\\{\\{.*?\\}\\}|<%|\\{%|@RenderBody') AND NOT regexp_matches(regexp_extract(html, '(?s)<body>(.*)', 1), '%[a-zA-Z][A-Za-z0-9_.]*%')",
    "presentational-spacing": "SELECT page_id, '1.3.1' AS sc, 'majeur' AS severity, TRUE AS advisory, 'presentational-spacing' AS msg_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)>([^<]*)<', 1)) AS t FROM pages) WHERE regexp_matches(t, '(^|[^\\p{L}])(\\p{L}[ \\x{A0}]){4,}\\p{L}([^\\p{L}]|$)|\\x{A0}{3,}') GROUP BY page_id",
}


def _seed_id(i: int) -> int:
    return -(i + 1)


def _rule_query(rule: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        seeds = spark.createDataFrame([(_seed_id(i), html) for i, (html, _) in enumerate(SEEDS[rule])], "page_id long, html string")
        pages = table(spark, sf_dir, "pages").select("page_id", "html").unionByName(seeds)
        if rule in MADE:
            made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
            pages = pages.unionByName(made.select((-1000 - F.col("k")).alias("page_id"), F.expr(MADE[rule][0]).alias("html")))
        slim = rules.needed(spark, [rule])
        found = rules.findings(elements(pages, slim[0] if slim else None), [rule])
        return found.groupBy("page_id", "sc", "severity", "advisory", "msg_id").agg(F.count(F.lit(1)).alias("n"))

    return run


def _made_sql(rule: str) -> str:
    _, n, sc, severity, advisory, variant = MADE[rule]
    msg = f"{rule}.{variant}" if variant else rule
    return f" UNION ALL SELECT -1000 - k, '{sc}', '{severity}', {str(advisory).upper()}, '{msg}', CAST(n AS BIGINT) FROM (SELECT k, {n} AS n FROM (SELECT s_suppkey AS k FROM supplier)) WHERE n > 0"


for _rule in rules.RULES:
    _name = "rule_" + _rule.replace("-", "_")
    QUERIES[_name] = _rule_query(_rule)
    _rows = [
        (_seed_id(i), sc, severity, advisory, f"{_rule}.{variant}" if variant else _rule, n)
        for i, (_, expected) in enumerate(SEEDS[_rule]) for sc, severity, advisory, variant, n in expected
    ]
    ORACLES[_name] = values(_FOUND, _rows) + (f" UNION ALL {ON_PAGES[_rule]}" if _rule in ON_PAGES else "") + (_made_sql(_rule) if _rule in MADE else "")


# --- pages

_CLEAN = "regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script>.*?</script>', '<script>', 'gs')"


def _elements(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return elements(table(spark, sf_dir, "pages"), columns)


@query(f"SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all({_CLEAN}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
def pages_tags(spark, sf_dir):
    return _elements(spark, sf_dir, ["tag"]).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query("SELECT lower(regexp_extract(html, '<html[^>]*lang=\"([A-Za-z]+)', 1)) AS lang, count(*) AS n FROM pages GROUP BY 1")
def pages_languages(spark, sf_dir):
    rows = _elements(spark, sf_dir, ["tag", "attrs"]).where("tag = 'html'")
    return rows.groupBy(F.lower(F.split(F.col("attrs")["lang"], "-")[0]).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_e}', '{_c}')"


@query(f"SELECT page_id, title, CAST(length(title) AS BIGINT) AS n_chars FROM (SELECT page_id, nullif(trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')), '') AS title FROM pages)")
def pages_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", urls.title_of(F.col("html")).alias("title"))
    return rows.withColumn("n_chars", F.char_length("title").cast("long"))


@query(f"SELECT page_id, CAST(len(regexp_extract_all({_CLEAN}, '<h1')) AS BIGINT) AS h1, CAST(len(regexp_extract_all({_CLEAN}, '<h[1-6]')) AS BIGINT) AS headings, CAST(len(regexp_extract_all({_CLEAN}, '<a ')) AS BIGINT) AS links FROM pages")
def pages_headings(spark, sf_dir):
    count = lambda c: F.count_if(c).alias
    return _elements(spark, sf_dir, ["tag"]).groupBy("page_id").agg(count(F.col("tag") == "h1")("h1"), count(F.col("tag").rlike("^h[1-6]$"))("headings"), count(F.col("tag") == "a")("links"))


@query(
    "WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>')) AS x FROM pages), b AS (SELECT page_id, regexp_extract(x, '<a href=\"([^\"]*)\">', 1) AS href, trim(regexp_extract(x, '>([^<]*)<', 1)) AS t FROM a) "
    "SELECT 'link|' || replace(t, '&amp;', '&') || '|' || replace(href, '&amp;', '&') AS cls, count(*) AS occurrences, count(DISTINCT page_id) AS pages FROM b GROUP BY 1"
)
def pages_link_classes(spark, sf_dir):
    return harvest.collapsed(harvest.harvest(_elements(spark, sf_dir, ["tag", "attrs", "text"]), ["links"])).select("cls", "occurrences", "pages")


@query("SELECT 'headings' AS subject, (SELECT count(DISTINCT regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) FROM pages) AS classes, (SELECT count(*) FROM pages WHERE html LIKE '%<h1>%') AS occurrences, (SELECT count(*) FROM pages WHERE html LIKE '%<h1>%') AS pages UNION ALL SELECT 'declaredLang', (SELECT count(DISTINCT regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)) FROM pages), (SELECT count(*) FROM pages), (SELECT count(*) FROM pages)")
def pages_population(spark, sf_dir):
    return harvest.population(harvest.harvest(_elements(spark, sf_dir, ["tag", "attrs", "text"]), ["headings", "declaredLang"]))


@query(
    "WITH m AS (SELECT s_suppkey AS k FROM supplier), n AS ("
    + " UNION ALL ".join(f"SELECT '{subject}' AS subject, k, CAST({n} AS BIGINT) AS n FROM m" for subject, n in SUBJECT_COUNTS.items())
    + ") SELECT subject, k AS page_id, n AS occurrences FROM n WHERE n > 0"
)
def made_subjects(spark, sf_dir):
    """Fourteen subjects harvested from pages made from table rows."""
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    pages = made.select(F.col("k").alias("page_id"), F.expr(EVIDENCE).alias("html"))
    rows = harvest.harvest(elements(pages), list(SUBJECT_COUNTS))
    return rows.groupBy("subject", "page_id").agg(F.count(F.lit(1)).alias("occurrences"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-z]+://[^/?]*(?:/[^?]*)?/)index\\.x?html?(\\?|$)', '\\1\\2'), '^([a-z]+://[^/?]+)(\\?|$)', '\\1/\\2') AS canonical FROM pages")
def pages_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query("SELECT page_id, slug, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS id FROM (SELECT page_id, slug, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM (SELECT page_id, trim(regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages))")
def pages_slugs(spark, sf_dir):
    return urls.page_ids(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "slug", "id")


@query("SELECT lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) AS origin, count(*) AS n FROM pages GROUP BY 1")
def pages_origins(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.origin_of(F.col("url")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT page_id, count(DISTINCT regexp_replace(href, '#.*$', '')) AS links FROM (SELECT page_id, trim(unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1))) AS href FROM pages) "
    "WHERE href LIKE '/%' AND NOT regexp_matches(href, '(?i)\\.(pdf|docx?|pptx?|xlsx?|odt|ods|odp|rtf|csv|zip|rar|7z|gz|tar|epub|dmg|exe|pkg|mp3|mp4|m4a|m4v|avi|mov|wmv|webm|ogg|wav|png|jpe?g|gif|svg|webp|avif|ico|woff2?|ttf|otf)$') GROUP BY page_id"
)
def pages_links(spark, sf_dir):
    return urls.links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count_distinct("target").alias("links"))


@query("SELECT page_id, links FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links FROM pages) ORDER BY links DESC, page_id LIMIT 10")
def pages_most_links(spark, sf_dir):
    rows = _elements(spark, sf_dir, ["tag"]).where("tag = 'a'").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
    return rows.orderBy(F.desc("links"), "page_id").limit(10)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def documents_distinct(spark, sf_dir):
    return changes.distinct_sources(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def documents_distinct_squeezed(spark, sf_dir):
    return changes.distinct_sources(table(spark, sf_dir, "documents"), "text", "doc_id", squeeze=True).select("doc_id")


# --- verdicts over all pages

_NORMATIVE = f"({ON_PAGES['missing-main-landmark']})"
_ADVISED = f"({ON_PAGES['presentational-spacing']})"
_CRITERIA = values("sc VARCHAR, guideline VARCHAR, level VARCHAR, how VARCHAR", [(sc, ".".join(sc.split(".")[:2]), level, how) for sc, (level, how) in V.CRITERIA.items()])
_DECLARED = "('1.2.1','1.2.2','1.2.3','1.2.4','1.2.5','2.5.4','3.3.1','3.3.2','3.3.3','3.3.4','3.3.7','3.3.8','1.3.5','2.1.4','2.2.1','2.2.2','2.3.1','2.5.1','2.5.2','2.5.7')"
#: The given pages hold no code but their own script element, so that only what elements tell can apply to them; pages made from rows hold the rest.
_HOLDS = lambda *tags: " OR ".join(f"html LIKE '%<{t}%'" for t in tags)
_APPLICABLE = f"""
SELECT unnest(['1.2.1','1.2.2','1.2.3','1.2.4','1.2.5']) AS sc, bool_or({_HOLDS('audio', 'video')}) AS ok FROM pages
UNION ALL SELECT unnest(['1.3.5','3.3.1','3.3.2','3.3.3','3.3.4','3.3.7','3.3.8']), bool_or({_HOLDS('input', 'select', 'form')}) FROM pages
UNION ALL SELECT unnest(['1.4.2','2.2.2']), bool_or({_HOLDS('audio', 'video')}) FROM pages
UNION ALL SELECT '2.3.1', bool_or({_HOLDS('script', 'img')}) FROM pages
UNION ALL SELECT unnest(['2.4.2','3.1.1']), bool_or({_HOLDS('html')}) FROM pages
"""
_STATUS = f"""
WITH f AS (SELECT sc, sum(n) FILTER (NOT advisory) AS n, sum(n) FILTER (advisory) AS a FROM (SELECT * FROM {_NORMATIVE} UNION ALL SELECT * FROM {_ADVISED}) GROUP BY sc),
s AS (
  SELECT d.sc, d.guideline, d.level, d.how, coalesce(f.n, 0) AS normative, coalesce(f.a, 0) AS advised, coalesce(p.ok, FALSE) AS ok
  FROM ({_CRITERIA}) d LEFT JOIN f ON f.sc = d.sc LEFT JOIN ({_APPLICABLE}) p ON p.sc = d.sc),
t AS (
  SELECT sc, guideline, level, how, CAST(normative AS BIGINT) AS normative, CAST(advised AS BIGINT) AS advised,
         CASE WHEN how = 'static' AND NOT ok THEN 'C' WHEN normative > 0 THEN 'NC' WHEN how = 'static' THEN 'C'
              WHEN sc IN {_DECLARED} AND NOT ok THEN 'C' ELSE 'manual' END AS status,
         CASE WHEN how = 'static' THEN NOT ok ELSE normative = 0 AND sc IN {_DECLARED} AND NOT ok END AS inapplicable FROM s)
"""


def _findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(findings of the whole catalogue over all pages, the elements they were found on): one parse, one sort, one write."""
    parsed = materialize(rules.prepared(elements(table(spark, sf_dir, "pages"))), "elements")
    return rules.findings(parsed, ready=True), parsed


def _audit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, criteria, pages) of the whole catalogue over all pages."""
    pages = table(spark, sf_dir, "pages")
    found, parsed = _findings(spark, sf_dir)
    found = materialize(found, "findings")
    return found, verdicts.criterion_status(found, verdicts.applicable_anywhere(parsed, pages)), pages


@query(f"WITH a AS ({values('i BIGINT, sc VARCHAR', [(i, sc) for i, (_, found) in enumerate(APPLIES) for sc in found])}) SELECT c_custkey AS page_id, sc FROM customer JOIN a ON a.i = c_custkey % {len(APPLIES)}")
def made_applicable(spark, sf_dir):
    """Which criteria apply to each page made from a row, one page in turn for every branch that decides it."""
    k = F.col("c_custkey")
    markup = F.element_at(F.array(*[F.lit(html) for html, _ in APPLIES]), (k % len(APPLIES) + 1).cast("int"))
    pages = table(spark, sf_dir, "customer").select(k.alias("page_id"), markup.alias("html"))
    return verdicts.applicable_on_pages(elements(pages, ["tag", "attrs"]), pages)


@query(f"SELECT msg_id AS rule_id, severity, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM {_NORMATIVE} UNION ALL SELECT * FROM {_ADVISED}) GROUP BY 1, 2")
def audit_severities(spark, sf_dir):
    return _findings(spark, sf_dir)[0].groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(_STATUS + "SELECT sc, guideline, level, normative, advised, status, inapplicable FROM t")
def audit_criteria(spark, sf_dir):
    return _audit(spark, sf_dir)[1].select("sc", "guideline", "level", "normative", "advised", "status", "inapplicable")


@query(_STATUS + "SELECT guideline, count(*) FILTER (status = 'C') AS c, count(*) FILTER (status = 'NC') AS nc, count(*) FILTER (status = 'NA') AS na, count(*) FILTER (status = 'manual') AS manual FROM t GROUP BY guideline")
def audit_guidelines(spark, sf_dir):
    return verdicts.guideline_tallies(_audit(spark, sf_dir)[1])


@query(_STATUS + "SELECT count(*) FILTER (status = 'C') AS conforming, count(*) FILTER (status IN ('C', 'NC')) AS decided, CAST(floor(100.0 * count(*) FILTER (status = 'C') / count(*) FILTER (status IN ('C', 'NC')) + 0.5) AS BIGINT) AS pct FROM t")
def audit_conformance(spark, sf_dir):
    return verdicts.conformance(_audit(spark, sf_dir)[1])


_PAGE_STATUS = _STATUS + f""", g AS (
  SELECT p.page_id, t.sc, CASE WHEN o.n > 0 THEN 'NC' WHEN t.status IN ('manual', 'NA') OR t.inapplicable THEN t.status WHEN t.how <> 'static' THEN 'manual' ELSE 'C' END AS status
  FROM pages p CROSS JOIN t LEFT JOIN (SELECT page_id, sc, sum(n) AS n FROM {_NORMATIVE} GROUP BY 1, 2) o ON o.page_id = p.page_id AND o.sc = t.sc),
r AS (
  SELECT page_id, count(*) FILTER (status IN ('C', 'NC')) AS decided, count(*) AS total,
         CAST(CASE WHEN count(*) FILTER (status IN ('C', 'NC')) > 0 THEN floor(100.0 * count(*) FILTER (status = 'C') / count(*) FILTER (status IN ('C', 'NC')) + 0.5) END AS BIGINT) AS rate FROM g GROUP BY page_id)
"""


def _page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, criteria, pages = _audit(spark, sf_dir)
    return verdicts.page_status(found, materialize(criteria, "criteria"), pages.select("page_id", F.lit("snapshot").alias("basis")))


@query(_PAGE_STATUS + "SELECT page_id, decided, total, rate FROM r")
def audit_page_rates(spark, sf_dir):
    return verdicts.page_rates(_page_status(spark, sf_dir))


@query(_PAGE_STATUS + "SELECT avg(rate) AS rate, count(*) AS pages FROM r WHERE rate IS NOT NULL")
def audit_average_rate(spark, sf_dir):
    return verdicts.page_rates(_page_status(spark, sf_dir)).where("rate is not null").agg(F.avg("rate").alias("rate"), F.count(F.lit(1)).alias("pages"))


@query(_PAGE_STATUS + "SELECT sc, count(*) FILTER (status = 'C') AS conforming, count(*) FILTER (status = 'NC') AS failing, count(*) FILTER (status = 'NA') AS absent, count(*) FILTER (status = 'manual') AS open FROM g GROUP BY sc")
def audit_grid(spark, sf_dir):
    """The grid of all pages folded to one row per criterion; ``audit_grid_pages`` has its cells."""
    marked = verdicts.marks(_page_status(spark, sf_dir))
    count = lambda mark, name: F.count_if(F.col("mark") == mark).alias(name)
    return marked.groupBy("sc").agg(count("C", "conforming"), count("NC", "failing"), count("NA", "absent"), count("?", "open"))


@query(_PAGE_STATUS + "SELECT page_id, sc, replace(status, 'manual', '?') AS mark FROM g")
def audit_grid_pages(spark, sf_dir):
    return verdicts.marks(_page_status(spark, sf_dir))


@query(f"SELECT sc, 'majeur' AS severity, CAST(2 * sum(n) AS BIGINT) AS points, CASE WHEN 2 * sum(n) <= 4 THEN 'S' WHEN 2 * sum(n) <= 12 THEN 'M' ELSE 'L' END AS bucket, CAST(sum(n) AS BIGINT) AS occurrences, bool_and(advisory) AS advisory FROM (SELECT * FROM {_NORMATIVE} UNION ALL SELECT * FROM {_ADVISED}) GROUP BY sc")
def audit_units(spark, sf_dir):
    return verdicts.units(_findings(spark, sf_dir)[0])


@query(f"SELECT 'page-criterion ' || page_id || ' ' || sc AS title, CAST(sum(n) AS BIGINT) AS occurrences, 'majeur' AS severity FROM (SELECT * FROM {_NORMATIVE} UNION ALL SELECT * FROM {_ADVISED}) GROUP BY page_id, sc")
def audit_tickets(spark, sf_dir):
    return verdicts.tickets(_findings(spark, sf_dir)[0], "page-criterion")


@query(f"SELECT rule_id, CAST(row_number() OVER (ORDER BY first_page, within) - 1 AS INTEGER) AS rule_index, level, results FROM (SELECT msg_id AS rule_id, CASE WHEN advisory THEN 'note' ELSE 'warning' END AS level, min(page_id) AS first_page, bool_and(advisory) AS within, CAST(sum(n) AS BIGINT) AS results FROM (SELECT * FROM {_NORMATIVE} UNION ALL SELECT * FROM {_ADVISED}) GROUP BY 1, 2)")
def audit_sarif(spark, sf_dir):
    found, parsed = _findings(spark, sf_dir)
    found = rules.located(materialize(found, "findings"), parsed)
    return sinks.sarif_results(found).groupBy("rule_id", "rule_index", "level").agg(F.count(F.lit(1)).alias("results"))


@query("SELECT 'new' AS change, count(*) AS n FROM pages WHERE html LIKE '<!DOCTYPE html><html lang=\"fr\"%' HAVING count(*) > 0")
def audit_baseline(spark, sf_dir):
    """Against an earlier state in which French pages had a main landmark: those pages' findings are new."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    main = F.regexp_replace(F.regexp_replace("html", "<article>", "<main>"), "</article>", "</main>")
    earlier = pages.withColumn("html", F.when(F.col("html").contains('<html lang="fr"'), main).otherwise(F.col("html")))
    states = []
    for p in (pages, earlier):
        found = rules.findings(elements(p), ["missing-main-landmark"])
        states.append(found.withColumn("finding_id", F.concat_ws("|", "rule_id", "sc", F.col("page_id").cast("string"))))
    return changes.against_baseline(*states).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, 'p' AS key, CAST(1 AS BIGINT) AS surplus FROM (SELECT page_id, len(regexp_extract_all({_CLEAN}, '<p>')) AS n FROM pages) WHERE n > 0")
def audit_surplus(spark, sf_dir):
    """Occurrences of a tag beyond an earlier count that held one paragraph less per page."""
    current = materialize(_elements(spark, sf_dir, ["tag"]).select("page_id", F.col("tag").alias("key"), "ord"), "occurrences")
    counts = current.groupBy("page_id", "key").agg(F.count(F.lit(1)).alias("n"))
    earlier = counts.withColumn("n", F.when(F.col("key") == "p", F.col("n") - 1).otherwise(F.col("n")))
    return changes.surplus(current, earlier).where("state = 'new'").groupBy("page_id", "key").agg(F.count(F.lit(1)).alias("surplus"))


@query("SELECT sc, CAST(row_number() OVER (ORDER BY list_transform(string_split(sc, '.'), lambda x: CAST(x AS INTEGER))) AS BIGINT) AS place FROM (" + _CRITERIA + ")")
def criteria_order(spark, sf_dir):
    rows = verdicts.criteria_dim(spark).select("sc", verdicts.dotted(F.col("sc")).alias("k"))
    from pyspark.sql import Window

    return rows.select("sc", F.row_number().over(Window.orderBy("k")).cast("long").alias("place"))  # 55 rows


@query("SELECT kind, key, TRUE AS anywhere, n = (SELECT count(*) FROM pages) AS everywhere FROM (SELECT 'tag' AS kind, tag AS key, count(DISTINCT page_id) AS n FROM (SELECT page_id, unnest(regexp_extract_all(" + _CLEAN + ", '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 2)")
def pages_coverage(spark, sf_dir):
    return changes.shared_coverage(_elements(spark, sf_dir, ["tag"]).select("page_id", F.lit("tag").alias("kind"), F.col("tag").alias("key")))


# --- fixtures: graphs, signals, packs, verdict state

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")]


@query("WITH RECURSIVE e(src, dst) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + "), r(root, node, depth) AS (SELECT DISTINCT src, src, 0 FROM e UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 6) SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2")
def graph_reach(spark, sf_dir):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    return graph.reach(edges.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct(), edges).select("root", "node", F.col("depth").cast("int").alias("depth"))


@query(values("file VARCHAR, name VARCHAR, def_file VARCHAR, def_name VARCHAR", [("app", "Button", "lib/button", "Button"), ("app", "UI.Icon", "lib/icon", "Icon"), ("app", "Local", "app", "Local")]))
def graph_components(spark, sf_dir):
    """A barrel of barrels, a namespace member, a local definition, a cycle and an unknown name."""
    bindings = [("app", "Button", "barrel", "Button"), ("barrel", "*", "index", "*"), ("index", "Button", "lib/button", "Button"), ("index", "*", "barrel", "*"), ("app", "UI", "ui", "*"), ("ui", "Icon", "lib/icon", "Icon"), ("app", "Lost", "barrel", "Lost")]
    usages = spark.createDataFrame([("app", "Button"), ("app", "UI.Icon"), ("app", "Local"), ("app", "Lost")], "file string, name string")
    components = spark.createDataFrame([("lib/button", "Button"), ("lib/icon", "Icon"), ("app", "Local")], "file string, name string")
    return graph.resolved(usages, spark.createDataFrame(bindings, "file string, local string, target string, imported string"), components)


@query(values("file VARCHAR, line INTEGER, rule_id VARCHAR, sc VARCHAR, severity VARCHAR", [("a", 1, "cross-icon-only-unnamed", "4.1.2", "bloquant"), ("a", 3, "cross-prop-drilled-name-lost", "4.1.2", "majeur")]))
def graph_cross_findings(spark, sf_dir):
    usages = [("a", 1, "Icon", False, "", {}, "i", "Icon"), ("a", 2, "Icon", False, "", {"aria-label": "x"}, "i", "Icon"), ("a", 3, "Drop", False, "", {"title": "t"}, "d", "Drop"), ("a", 4, "Icon", True, "", {}, "i", "Icon")]
    u = spark.createDataFrame(usages, "file string, line int, name string, spread boolean, text string, attrs map<string,string>, def_file string, def_name string")
    d = spark.createDataFrame([("i", "Icon", True, True, True, False, ["aria-label"]), ("d", "Drop", True, False, False, False, ["children"])], "file string, name string, has_control boolean, icon_only boolean, accepts_name boolean, control_has_name boolean, reads array<string>")
    return graph.cross_findings(u, d)


@query(values("page VARCHAR, reason VARCHAR", [("home", "lib"), ("about", "about.tsx")]))
def graph_affected(spark, sf_dir):
    pages = spark.createDataFrame([("home", "home.tsx"), ("about", "about.tsx"), ("help", "help.tsx")], "page string, source string")
    edges = spark.createDataFrame([("home.tsx", "card"), ("card", "lib"), ("help.tsx", "text")], "src string, dst string")
    return graph.affected_pages(pages, edges, spark.createDataFrame([("lib",), ("about.tsx",)], "file string"), ["^tailwind\\.config"])


@query(values("file VARCHAR, page VARCHAR", [("/repo/app/page.tsx", "home"), ("help.tsx", "help")]))
def graph_suffixes(spark, sf_dir):
    files = spark.createDataFrame([("/repo/app/page.tsx",), ("help.tsx",), ("other/page2.tsx",)], "file string")
    sources = spark.createDataFrame([("home", 0, "app/page.tsx"), ("second", 1, "app/page.tsx"), ("help", 2, "src/help.tsx")], "page string, position int, source string")
    return graph.by_suffix(files, sources)


_STYLED = '<body><div><p>low</p><p>fine</p><b>big</b></div><p>see <a href="/x">here</a> now</p><p><a href="/y">alone</a></p><input><button disabled>off</button></body>'
_BASE = {"backgroundColor": "rgb(255, 255, 255)", "color": "rgb(0, 0, 0)"}
_STYLES = [
    (-1, 0, "body", _BASE), (-1, 1, "div", {"color": "rgb(0, 0, 0)"}), (-1, 2, "p", {"color": "rgb(200, 200, 200)"}), (-1, 3, "p", {"color": "rgb(10, 10, 10)"}),
    (-1, 4, "b", {"color": "rgb(140, 140, 140)", "fontSize": "24px"}), (-1, 5, "p", {"color": "rgb(0, 0, 0)", "fontWeight": "400"}), (-1, 6, "a", {"color": "rgb(0, 0, 200)"}),
    (-1, 7, "p", {"color": "rgb(0, 0, 0)"}), (-1, 8, "a", {"color": "rgb(0, 0, 200)"}), (-1, 9, "input", {"backgroundColor": "rgb(250, 250, 250)"}), (-1, 10, "button", {"color": "rgb(220, 220, 220)"}),
    (-2, 0, "div", {"color": "rgb(255, 255, 255)"}),
]


def _signals(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    pages = spark.createDataFrame([(-1, _STYLED), (-2, "<p>shifted digest</p>")], "page_id long, html string")
    parsed = materialize(elements(pages, [*STANDARD, "path"]), "parsed")
    styles = spark.createDataFrame(_STYLES, "page_id long, ord int, tag string, css map<string,string>")
    return parsed, signals.aligned(styles, parsed)


@query(values("page_id BIGINT, ord INTEGER, rule_id VARCHAR, sc VARCHAR, severity VARCHAR, detail VARCHAR", [(-1, 2, "rendered-contrast", "1.4.3", "majeur", "1.67"), (-1, 6, "rendered-link-colour-only", "1.4.1", "majeur", "1.83"), (-1, 9, "rendered-nontext-contrast", "1.4.11", "majeur", "input")]))
def signals_rendered(spark, sf_dir):
    parsed, styles = _signals(spark)
    return documents.union_all([signals.rendered_contrast(parsed, styles), signals.links_by_colour(parsed, styles), signals.control_boundaries(parsed, styles)])


@query(values("page_id BIGINT, ord INTEGER, rule_id VARCHAR, sc VARCHAR, severity VARCHAR, detail VARCHAR", [(-1, 1, "rendered-contrast-pixel", "1.4.3", "majeur", "1.67")]))
def signals_pixels(spark, sf_dir):
    pages = spark.createDataFrame([(-1, "<div><p>over an image</p><p>over noise</p></div>")], "page_id long, html string")
    image = {"backgroundImage": "url(x.png)"}
    styles = spark.createDataFrame([(-1, 0, "div", image), (-1, 1, "p", {"color": "rgb(255, 255, 255)"}), (-1, 2, "p", {"color": "rgb(255, 255, 255)"})], "page_id long, ord int, tag string, css map<string,string>")
    pixels = [(-1, 1, 200, 200, 200)] * 7 + [(-1, 1, 10, 10, 10)] * 3 + [(-1, 2, 30 * i, 20 * i, 10 * i) for i in range(8)]
    return signals.pixel_contrast(elements(pages, [*STANDARD, "path"]), styles, signals.dominant_colours(spark.createDataFrame(pixels, "page_id long, ord int, r int, g int, b int")))


@query(values("page_id BIGINT, ord INTEGER, rule_id VARCHAR, sc VARCHAR, severity VARCHAR, detail VARCHAR", [(-1, 0, "rendered-focus-not-visible", "2.4.7", "majeur", ""), (-2, 0, "rendered-orientation-lock", "1.3.4", "majeur", "(orientation: portrait)")]))
def signals_styles(spark, sf_dir):
    pages = spark.createDataFrame([(i, "<a href='#'>x</a>") for i in (-1, -2, -3, -4)], "page_id long, html string")
    rows = [
        (-1, 0, "a:focus", None, {"outline": "none"}), (-1, 1, "main:focus", None, {"boxShadow": "0 0 2px red"}), (-2, 0, "a:focus", None, {"outline": "0"}), (-2, 1, ".b:focus", None, {"boxShadow": "0 0 2px red"}),
        (-2, 2, "html", "(orientation: portrait)", {"transform": "rotate(90deg)"}), (-3, 0, "a:focus", None, {"outline": "none"}), (-4, 0, "div.card", "(orientation: portrait)", {"transform": "rotate(-90deg)"}),
    ]
    css = spark.createDataFrame(rows, "page_id long, i int, selector string, media string, decls map<string,string>")
    meta = spark.createDataFrame([(-1, 0, False), (-2, 0, False), (-3, 1, False), (-4, 0, False)], "page_id long, unreadable int, truncated boolean")
    return signals.focus_not_visible(elements(pages), css, meta).unionByName(signals.orientation_locked(css, meta))


PDF = "file string, readable boolean, tagged boolean, lang string, title string, display_doc_title boolean, pages int, fonts int, text_ops int, content_scanned boolean, has_structure boolean, headings int, tables_without_th int, figures int, figures_without_alt int"
PDFS = [
    ("good", True, True, "en", "T", True, 3, 2, 50, True, True, 4, 0, 0, 0), ("scan", True, False, "", "", False, 2, 0, 0, True, False, 0, 0, 0, 0),
    ("shallow", True, True, "fr", "T", False, 1, 1, 9, True, True, 0, 1, 0, 0), ("broken", False, False, None, None, False, 0, 0, 0, False, False, 0, 0, 0, 0),
    ("figures", True, True, "en", "T", True, 1, 0, 0, True, True, 1, 0, 2, 0),
]


@query(
    values(
        "file VARCHAR, rule_id VARCHAR, sc VARCHAR, severity VARCHAR, advisory BOOLEAN, detail VARCHAR",
        [
            ("scan", "pdf-untagged", "1.3.1", "majeur", False, ""), ("scan", "pdf-lang-missing", "3.1.1", "majeur", False, ""), ("scan", "pdf-title-missing", "2.4.2", "majeur", False, "missing"),
            ("scan", "pdf-no-text", "1.1.1", "bloquant", False, ""), ("shallow", "pdf-title-missing", "2.4.2", "mineur", False, "not-displayed"),
            ("shallow", "pdf-structure-shallow", "1.3.1", "mineur", True, "no-heading"), ("shallow", "pdf-structure-shallow", "1.3.1", "mineur", True, "table-no-th"),
        ],
    )
)
def pdf_rules(spark, sf_dir):
    return documents.pdf_findings(spark.createDataFrame(PDFS, PDF))


PACK_RULES = [
    {"id": "pdf-link", "sc": "2.4.4", "severity": "mineur", "match": {"tag": "a", "attrs": [{"name": "href", "op": "matches", "value": "\\.pdf$"}], "text": {"op": "lacks", "value": "PDF"}}},
    {"id": "bare-figure", "sc": "1.1.1", "severity": "majeur", "advisory": True, "match": {"tag": "figure", "has": [{"tag": "img"}], "lacks": [{"tag": "figcaption"}]}},
    {"id": "no-main", "sc": "1.3.1", "severity": "majeur", "match": {"tag": "body", "scope": "page", "lacks": [{"tag": "main"}]}},
]


@query(
    values("page_id BIGINT, rule_id VARCHAR, sc VARCHAR, severity VARCHAR, advisory BOOLEAN, n BIGINT", [(-1, "pack:demo:pdf-link", "2.4.4", "mineur", False, 1), (-1, "pack:demo:bare-figure", "1.1.1", "majeur", True, 1)])
    + " UNION ALL SELECT page_id, 'pack:demo:no-main', '1.3.1', 'majeur', FALSE, CAST(1 AS BIGINT) FROM pages WHERE html NOT LIKE '%<main%' AND html LIKE '%<body%'"
)
def pack_rules(spark, sf_dir):
    fragment = '<a href="a.pdf">report</a><a href="b.pdf">report (PDF)</a><figure><img></figure><figure><img><figcaption>c</figcaption></figure>'
    pages = table(spark, sf_dir, "pages").select("page_id", "html").unionByName(spark.createDataFrame([(-1, fragment)], "page_id long, html string"))
    found = packs.pack_findings(materialize(elements(pages), "parsed"), "demo", PACK_RULES)
    return found.groupBy("page_id", "rule_id", "sc", "severity", "advisory").agg(F.count(F.lit(1)).alias("n"))


@query(values("id VARCHAR, status VARCHAR, normative BIGINT", [("1", "NC", 1), ("2", "manual", 0), ("3", "C", 0), ("4", "NA", 0), ("5", "NC", 1)]))
def pack_criteria(spark, sf_dir):
    criteria = spark.createDataFrame([("1.1.1", "NC", False), ("2.4.2", "C", False), ("1.4.2", "C", True), ("1.3.1", "manual", False)], "sc string, status string, inapplicable boolean")
    found = spark.createDataFrame([("1.1.1", "img-alt-missing", False), ("1.3.1", "presentational-element", True)], "sc string, rule_id string, advisory boolean")
    crosswalk = spark.createDataFrame([("1", "1.1.1"), ("2", "1.1.1"), ("3", "2.4.2"), ("3", "1.4.2"), ("4", "1.4.2"), ("5", "1.3.1")], "id string, sc string")
    applies = spark.createDataFrame([("1", "img-*"), ("2", "canvas-fallback-missing"), ("5", "presentational-*")], "id string, pattern string")
    return packs.derived(criteria, found, crosswalk, applies, spark.createDataFrame([("presentational-element", False)], "rule_id string, advisory boolean"))


@query(values("sc VARCHAR, state VARCHAR", [("1.1.1", "fresh"), ("1.3.1", "stale"), ("2.4.4", "fresh"), ("2.4.6", "fresh"), ("3.1.2", "obsolete"), ("3.2.3", "missing"), ("3.3.2", "stale")]))
def ledger_replay(spark, sf_dir):
    keys = {"1.1.1": ["a", "b"], "1.3.1": ["a", "c"], "2.4.4": ["x"], "2.4.6": ["p"]}
    evidence = spark.createDataFrame([(sc, k) for sc, ks in keys.items() for k in ks], "sc string, key string")
    record = [("1.1.1", "C", ["a", "b"]), ("1.3.1", "C", ["a", "b"]), ("2.4.4", "NC", ["y"]), ("2.4.6", "C", ["p", "q"]), ("3.1.2", "C", ["z"]), ("3.3.2", "C", ["z"])]
    ledger = spark.createDataFrame(record, "sc string, verdict string, keys array<string>")
    ledger = ledger.select("sc", "verdict", F.transform("keys", lambda k: F.left(F.sha2(k.cast("binary"), 256), F.lit(16))).alias("anchors"), changes.fingerprint(F.col("keys")).alias("fingerprint"))
    return changes.replayed(ledger, evidence, spark.createDataFrame([(s,) for s in ("1.1.1", "1.3.1", "2.4.4", "2.4.6", "3.2.3", "3.3.2")], "sc string"))


@query(
    values(
        "sc VARCHAR, violation VARCHAR",
        [("a", "duplicate"), ("a", "citation"), ("b", "finding"), ("b", "decided-by"), ("c", "not-open"), ("d", "missing"), ("e", "auditor"), ("e", "unknown-verdict"), ("f", "reason"), ("g", "justification"), ("h", "no-verdict")],
    )
)
def verdict_contract(spark, sf_dir):
    schema = "sc string, verdict string, justification string, decided_by string, auditor string, citations int, findings int, reason string"
    rows = [
        ("a", "C", "ok", "agent", None, 0, 0, None), ("a", "C", "ok", "agent", None, 2, 0, None), ("b", "NC", None, "robot", None, 0, 0, None), ("c", "C", "ok", "agent", None, 1, 0, None),
        ("e", "yes", "ok", "human", " ", 1, 0, None), ("f", "manual", None, "agent", None, 0, 0, ""), ("g", "NA", " ", "agent", None, 0, 0, None), ("h", None, None, "agent", None, 0, 0, None),
    ]
    return changes.contract_violations(spark.createDataFrame(rows, schema), spark.createDataFrame([(s,) for s in "abdefgh"], "sc string"))


@query(values("supported BIGINT, partial BIGINT, refuted BIGINT, unsupported BIGINT, invalid BIGINT, missing BIGINT", [(2, 1, 1, 0, 1, 1)]))
def verdict_review(spark, sf_dir):
    return changes.verdict_counts(spark.createDataFrame([("supported",), ("Supported ",), ("partial",), ("refuted",), ("maybe",), (None,)], "verdict string"))


@query(values("rule VARCHAR, failed BIGINT, caught BIGINT, clean BIGINT, false_positives BIGINT, verdict VARCHAR", [("r1", 2, 2, 1, 0, "consistent"), ("r2", 2, 1, 1, 0, "partially-consistent"), ("r3", 1, 1, 1, 1, "inconsistent"), ("r4", 1, 0, 0, 0, "not-scored")]))
def corpus_scoring(spark, sf_dir):
    """A test corpus of pages scored by what the rules really report on it."""
    cases = [
        ("r1", "t1", "failed", "<img src=a>"), ("r1", "t2", "failed", "<img src=b>"), ("r1", "t3", "passed", '<img alt="x">'), ("r2", "t4", "failed", "<button></button>"), ("r2", "t5", "failed", "<button>x</button>"),
        ("r2", "t6", "inapplicable", "<p>x</p>"), ("r3", "t7", "failed", "<blink>x</blink>"), ("r3", "t8", "passed", "<marquee>x</marquee>"), ("r4", "t9", "failed", "<p></p>"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "page_id long, rule string, testcase string, expected string, html string")
    found = rules.findings(elements(rows.select("page_id", "html")), ["img-alt-missing", "button-empty-name", "blink-marquee"])
    reported = found.join(rows.select("page_id", "testcase"), "page_id").select("testcase", F.col("rule_id").alias("engine_rule")).distinct()
    mapping = spark.createDataFrame([("r1", "img-alt-missing"), ("r2", "button-empty-name"), ("r3", "blink-marquee")], "rule string, engine_rule string")
    return changes.scored_corpus(rows.select("rule", "testcase", "expected"), reported, mapping)


@query(values("file VARCHAR, output VARCHAR", [("a", "<img alt=\"\"><p>new</p>"), ("b", "xYz")]))
def fixes_applied(spark, sf_dir):
    sources = spark.createDataFrame([("a", "<img><p>old</p>"), ("b", "xyz")], "file string, source string")
    edits = [("a", 4, 4, ' alt=""'), ("a", 8, 11, "new"), ("a", 5, 9, "overlap"), ("b", 1, 2, "Y"), ("b", 0, 3, "gone")]
    return changes.apply_edits(sources, spark.createDataFrame(edits, "file string, start int, end int, replacement string"))
