"""Named queries of the verdict contract: a verdict file made from ``customer`` (criteria) and ``orders`` (evidence, citations, claims) over the text of ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators import contract, review
from lintel.plans.registry import query
from lintel.plans.storage import materialize, table

_DRIFT = 2
_FILE = "CASE WHEN o % 35 = 0 THEN 'elsewhere/' || o % 7 || '.html' WHEN o % 15 = 0 THEN 'ci/.shots/pages/p' || o % 50 || '/dom.html' ELSE 'pages/' || o % 50 || '.html' END"
_LINE = "CASE WHEN o % 4 = 0 THEN 1 + o % 3 ELSE o % 60 END"
_SNIPPET = "CASE o % 20 WHEN 0 THEN 'no such words' WHEN 5 THEN NULL ELSE substr(html, CAST(1 + o % 200 AS INTEGER), 40) END"
_VERDICT = "CASE k % 6 WHEN 0 THEN 'C' WHEN 1 THEN 'NC' WHEN 2 THEN 'NA' WHEN 3 THEN 'manual' WHEN 5 THEN CASE WHEN k % 12 = 5 THEN 'perhaps' ELSE 'NC' END END"


def _canon(file: str) -> str:
    return f"CASE WHEN contains({file}, '.shots/pages/') THEN '.shots/pages/' || split_part({file}, '.shots/pages/', 2) ELSE {file} END"


_TABLES = f"""
k AS (SELECT c_custkey AS k, 'c' || c_custkey AS sc FROM customer),
oc AS (SELECT sc, k % 13 <> 0 AS complete FROM k WHERE k % 11 <> 0),
given AS (SELECT sc, k, {_VERDICT} AS verdict, CASE WHEN k % 19 = 0 THEN 2 ELSE 1 END AS times FROM k WHERE k % 17 <> 0),
i AS (SELECT given.* FROM given JOIN oc USING (sc)),
o AS (SELECT 'c' || o_custkey AS sc, o_orderkey AS o, html FROM orders JOIN pages ON page_id = o_orderkey % 50),
src AS (SELECT 'pages/' || page_id || '.html' AS file, html, length(html) - length(replace(html, chr(10), '')) + 1 AS n_lines FROM pages),
ev AS (SELECT sc, 'e' || o % 2 AS cls, {_FILE} AS file, {_LINE} AS line FROM o WHERE o % 3 = 0),
sib AS (SELECT sc, 'e' || o % 2 AS cls, {_FILE} AS file, {_LINE} AS line FROM o WHERE o % 3 = 1),
cited AS (SELECT sc, 'citation' AS kind, o, {_FILE} AS file, {_LINE} + o % 4 AS line, CAST(NULL AS VARCHAR) AS selector, {_SNIPPET} AS snippet FROM o WHERE o % 5 = 0),
claims AS (SELECT sc, 'claim' AS kind, o, CASE WHEN o % 21 <> 0 THEN {_FILE} END AS file, {_LINE} + o % 4 AS line, CASE WHEN o % 2 = 0 THEN 'p' END AS selector, {_SNIPPET} AS snippet,
           CASE WHEN o % 28 = 0 THEN '' WHEN o % 14 = 0 THEN sc || '.9' ELSE sc || '.1' END AS ref FROM o WHERE o % 7 = 0),
advice AS (SELECT sc, 'advice' AS kind, o, CASE WHEN o % 66 = 0 THEN '' ELSE {_FILE} END AS file, {_LINE} AS line, CAST(NULL AS VARCHAR) AS selector, {_SNIPPET} AS snippet FROM o WHERE o % 33 = 0),
engine AS (SELECT sc, {_FILE} AS file, {_LINE} + o % 4 AS line, CASE WHEN o % 2 = 0 THEN 'p' ELSE '' END AS selector FROM o WHERE o % 7 = 0 AND o % 8 = 0 AND CAST(substr(sc, 2) AS BIGINT) % 5 = 0),
clear AS (SELECT sc FROM i WHERE verdict IN ('C', 'NA') AND sc IN (SELECT sc FROM ev)),
nc AS (SELECT * FROM claims WHERE sc IN (SELECT sc FROM i WHERE verdict = 'NC')),
adv AS (SELECT * FROM advice WHERE sc IN (SELECT sc FROM i)),
pl AS (SELECT *, row_number() OVER () AS nr, {_canon('file')} AS path FROM (
  SELECT sc, kind, file, line, selector, snippet FROM cited WHERE sc IN (SELECT sc FROM clear)
  UNION SELECT sc, kind, file, line, selector, snippet FROM nc WHERE coalesce(file, '') <> '' UNION SELECT sc, kind, file, line, selector, snippet FROM adv WHERE file <> '')),
an AS (SELECT DISTINCT sc, {_canon('file')} AS path, line FROM (SELECT sc, file, line FROM ev UNION ALL SELECT sc, file, line FROM sib WHERE EXISTS (SELECT 1 FROM ev e WHERE e.sc = sib.sc AND e.cls = sib.cls))),
cand AS (
  SELECT nr, 1 AS how, cls, e.file AS e_file, e.line AS e_line FROM pl JOIN ev e ON e.sc = pl.sc AND {_canon('e.file')} = pl.path AND abs(e.line - pl.line) <= {_DRIFT} WHERE kind <> 'advice'
  UNION ALL SELECT nr, 3, s.cls, e.file, e.line FROM pl JOIN sib s ON s.sc = pl.sc AND {_canon('s.file')} = pl.path AND abs(s.line - pl.line) <= {_DRIFT} JOIN ev e ON e.sc = s.sc AND e.cls = s.cls WHERE kind <> 'advice'),
best AS (SELECT nr, how, e_file, e_line FROM (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY how, cls, e_file, e_line) AS n FROM cand) WHERE n = 1),
told AS (SELECT pl.*, how, e_file, e_line, lower(coalesce(nullif(regexp_extract(coalesce(snippet, ''), '<\\s*([a-zA-Z][\\w-]*)', 1), ''), selector, 'p')) = 'p' AND how IS NOT NULL AS alike,
  how = 1 OR kind = 'claim' AS own FROM pl LEFT JOIN best USING (nr)),
b AS (SELECT *, CASE WHEN own THEN e_file ELSE file END AS b_file, CASE WHEN own THEN e_line ELSE line END AS b_line FROM told),
g AS (SELECT b.*, coalesce(s.html IS NOT NULL AND b.line <= s.n_lines AND CASE WHEN trim(coalesce(snippet, '')) <> '' THEN snippet <> 'no such words' WHEN selector = 'p' THEN contains(lower(s.html), '<p') ELSE TRUE END, FALSE) AS stands,
  coalesce(alike AND t.html IS NOT NULL AND b_line <= t.n_lines AND contains(lower(t.html), '<p'), FALSE) AS backed,
  s.html IS NOT NULL OR CASE WHEN kind = 'claim' THEN how IS NOT NULL ELSE EXISTS (SELECT 1 FROM an WHERE an.sc = b.sc AND an.path = b.path AND abs(an.line - b.line) <= {_DRIFT}) END AS belongs
  FROM b LEFT JOIN src s ON s.file = b.file LEFT JOIN src t ON t.file = b_file),
x AS (
  SELECT sc, 'duplicate' AS violation, NULL AS place FROM given WHERE times > 1
  UNION ALL SELECT sc, 'missing', NULL FROM oc JOIN k USING (sc) WHERE k % 17 = 0 AND k % 34 <> 0
  UNION ALL SELECT sc, 'not-open', NULL FROM given WHERE k % 11 = 0
  UNION ALL SELECT sc, 'decided-by', NULL FROM i WHERE k % 10 = 1
  UNION ALL SELECT sc, 'auditor', NULL FROM i WHERE k % 10 = 0 AND k % 20 <> 0
  UNION ALL SELECT sc, 'no-verdict', NULL FROM i WHERE k % 6 = 4
  UNION ALL SELECT sc, 'unknown-verdict', NULL FROM i WHERE k % 12 = 5
  UNION ALL SELECT sc, 'justification', NULL FROM i WHERE verdict IN ('C', 'NA') AND k % 7 = 0
  UNION ALL SELECT sc, 'always-applicable', NULL FROM i WHERE verdict = 'NA' AND k % 7 = 1
  UNION ALL SELECT sc, 'incomplete-evidence', NULL FROM i WHERE verdict = 'C' AND k % 13 = 0
  UNION ALL SELECT sc, 'no-evidence', NULL FROM i WHERE verdict = 'C' AND sc NOT IN (SELECT sc FROM ev)
  UNION ALL SELECT sc, 'uncited', NULL FROM clear WHERE sc NOT IN (SELECT sc FROM cited)
  UNION ALL SELECT sc, 'no-finding', NULL FROM i WHERE verdict = 'NC' AND sc NOT IN (SELECT sc FROM claims)
  UNION ALL SELECT sc, 'reason', NULL FROM i WHERE verdict = 'manual' AND (k // 6) % 4 > 1
  UNION ALL SELECT sc, 'already-rendered', NULL FROM i WHERE verdict = 'manual' AND (k // 6) % 4 = 0 AND sc IN (SELECT sc FROM ev WHERE file LIKE '%dom.html')
  UNION ALL SELECT sc, 'claim-without-file', NULL FROM nc WHERE file IS NULL
  UNION ALL SELECT sc, 'advice-without-file', NULL FROM adv WHERE file = ''
  UNION ALL SELECT sc, 'claim-without-test', file || ':' || line FROM nc WHERE file IS NOT NULL AND ref = ''
  UNION ALL SELECT sc, 'foreign-test', file || ':' || line FROM nc WHERE file IS NOT NULL AND ref LIKE '%.9'
  UNION ALL SELECT n.sc, 'presupposed', n.file || ':' || n.line FROM nc n JOIN engine e ON e.sc = n.sc AND e.file = n.file AND e.line = n.line AND e.selector = coalesce(n.selector, '')
  UNION ALL SELECT sc, 'outside-evidence', file || ':' || line FROM g WHERE kind <> 'advice' AND NOT belongs
  UNION ALL SELECT sc, 'ungrounded', file || ':' || line FROM g WHERE NOT stands AND NOT backed),
w AS (SELECT DISTINCT sc, violation, place FROM x)
"""


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _verdict_file(spark: SparkSession, sf_dir: str) -> contract.VerdictFile:
    k, o = F.col("k"), F.col("o")
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), _text("c", F.col("c_custkey")).alias("sc"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html")
    raw = F.when(k % 6 == 0, "C").when(k % 6 == 1, "NC").when(k % 6 == 2, "NA").when(k % 6 == 3, "manual").when(k % 12 == 5, "perhaps").when(k % 6 == 5, " nc ")
    author = F.when(k % 10 == 0, "human").when(k % 10 == 1, "robot").when(k % 20 != 2, "agent")
    said = F.floor(k / 6) % 4
    reason = F.when(said == 0, "needs-rendered-dom").when(said == 1, " Undecidable ").when(said == 3, "later")
    given = keys.where(k % 17 != 0).select("sc", "k", raw.alias("verdict"), F.when(k % 7 != 0, "seen").otherwise(" ").alias("justification"), author.alias("decided_by"), F.when(k % 20 == 0, "Ada").alias("auditor"), reason.alias("reason"))
    given = given.unionByName(given.where(k % 19 == 0)).drop("k")
    orders = table(spark, sf_dir, "orders").select(_text("c", F.col("o_custkey")).alias("sc"), F.col("o_orderkey").alias("o"), (F.col("o_orderkey") % 50).cast("long").alias("page_id")).join(F.broadcast(pages.where("page_id < 50")), "page_id")  # fifty pages
    file = F.when(o % 35 == 0, _text("elsewhere/", o % 7, ".html")).when(o % 15 == 0, _text("ci/.shots/pages/p", o % 50, "/dom.html")).otherwise(_text("pages/", o % 50, ".html"))
    line = F.when(o % 4 == 0, 1 + o % 3).otherwise(o % 60).cast("int")
    later = (line + o % 4).cast("int")
    snippet = F.when(o % 20 == 0, "no such words").when(o % 20 != 5, F.substring("html", (1 + o % 200).cast("int"), F.lit(40)))
    none = F.lit(None).cast("string")
    cls = _text("e", o % 2).alias("cls")
    ref = F.when(o % 28 == 0, " ").when(o % 14 == 0, _text(F.col("sc"), ".9")).otherwise(_text(F.col("sc"), ".1"))
    tagged = F.when(o % 2 == 0, "p")
    claims = orders.where(o % 7 == 0)
    return contract.VerdictFile(
        verdicts=given,
        open_criteria=keys.where(k % 11 != 0).select("sc", (k % 13 != 0).alias("complete")),
        citations=orders.where(o % 5 == 0).select("sc", file.alias("file"), later.alias("line"), none.alias("selector"), snippet.alias("snippet")),
        claims=claims.select("sc", F.when(o % 21 != 0, file).alias("file"), later.alias("line"), tagged.alias("selector"), snippet.alias("snippet"), ref.alias("ref")),
        advice=orders.where(o % 33 == 0).select("sc", F.when(o % 66 == 0, "").otherwise(file).alias("file"), line.alias("line"), none.alias("selector"), snippet.alias("snippet")),
        evidence=orders.where(o % 3 == 0).select("sc", cls, file.alias("file"), line.alias("line"), F.lit("p").alias("selector"), none.alias("snippet"), none.alias("note")),
        siblings=orders.where(o % 3 == 1).select("sc", cls, file.alias("file"), line.alias("line")),
        sources=pages.select(_text("pages/", F.col("page_id"), ".html").alias("file"), F.col("html").alias("source")),
        tests=keys.select("sc", F.explode(F.array("sc", _text(F.col("sc"), ".1"))).alias("ref")),
        expected=keys.where(k % 34 == 0).select("sc"),
        always=keys.where(k % 7 == 1).select("sc"),
        engine=claims.where(o % 8 == 0).select(_text("x", F.col("sc")).alias("sc"), file.alias("file"), later.alias("line"), tagged.alias("selector")),
        presupposed=keys.where(k % 5 == 0).select("sc", _text("x", F.col("sc")).alias("presupposed")),
        folder=".shots/pages",
    )


@query(f"WITH {_TABLES} SELECT sc, violation, place FROM w")
def contract_violations(spark, sf_dir):
    """Every violation of a verdict file, with the place that is at fault."""
    return contract.violations(_verdict_file(spark, sf_dir), drift=_DRIFT)


@query(
    f"WITH {_TABLES} SELECT 'c' || k.k AS sc, CASE WHEN v.verdict IN ('C', 'NC', 'NA') AND w.sc IS NULL THEN v.verdict ELSE 'manual' END AS status, "
    "CASE WHEN v.verdict IN ('C', 'NC', 'NA') AND w.sc IS NULL THEN CASE WHEN k.k % 10 = 0 THEN 'human' ELSE 'agent' END END AS decided_by "
    "FROM k LEFT JOIN given v ON v.sc = k.sc LEFT JOIN (SELECT DISTINCT sc FROM w) w ON w.sc = k.sc WHERE k.k % 11 <> 0"
)
def contract_folded(spark, sf_dir):
    """The open criteria with the verdicts that broke no rule."""
    file = _verdict_file(spark, sf_dir)
    broken = materialize(contract.violations(file, drift=_DRIFT), "violations")
    verdicts = file.verdicts.select("sc", contract.canonical(F.col("verdict"), contract.VERDICTS).alias("verdict"), F.coalesce("decided_by", F.lit("agent")).alias("decided_by"))
    criteria: DataFrame = file.open_criteria.select("sc", F.lit("manual").alias("status"))
    return review.folded(criteria, verdicts.dropDuplicates(["sc"]), broken)
