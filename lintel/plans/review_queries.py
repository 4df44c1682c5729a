"""Named queries of the review operators.

Findings, evidence and verdicts are made from the ``events``, ``pages`` and ``orders`` tables in the same way on both sides,
so that the SQL computes its answers from whole tables and knows no expected rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import vocabulary as V
from lintel.operators import changes, checks, ledger, packs, review, verdicts
from lintel.plans.registry import query, values
from lintel.plans.storage import table

_DIM = [(sc, i, level, how) for i, (sc, (level, how)) in enumerate(V.CRITERIA.items())]
_N = len(_DIM)
_K = f"k AS ({values('sc VARCHAR, k BIGINT, level VARCHAR, how VARCHAR', _DIM)})"
#: Criteria with a status that depends on their number alone.
_STATE = "s AS (SELECT sc, k, level, how, CASE k % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'NC' ELSE 'manual' END AS status, k % 8 = 0 AS inapplicable FROM k)"
_FIND = (
    "f AS (SELECT 'f' || event_id AS finding_id, event_id AS seq, user_id % 40 AS page_id, k.sc, CASE event_id % 3 WHEN 0 THEN 'bloquant' WHEN 1 THEN 'majeur' ELSE 'mineur' END AS severity, "
    f"event_id % 5 = 0 AS advisory, event_type AS rule_id, CAST(event_id % 300 AS INTEGER) AS line, value FROM events JOIN k ON k.k = (event_id * 7) % {_N})"
)
_RANK = "CASE severity WHEN 'bloquant' THEN 0 WHEN 'majeur' THEN 1 ELSE 2 END"
_WITH = f"WITH {_K}, {_STATE}, {_FIND}"


def _criteria(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_DIM, "sc string, k long, level string, automatability string")
    status = F.when(F.col("k") % 4 == 0, "C").when(F.col("k") % 4 == 1, "NC").otherwise("manual")
    return rows.withColumn("status", status).withColumn("inapplicable", F.col("k") % 8 == 0)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, dim = table(spark, sf_dir, "events"), F.broadcast(_criteria(spark).select("sc", "k"))  # 55 rows
    severity = F.when(F.col("event_id") % 3 == 0, "bloquant").when(F.col("event_id") % 3 == 1, "majeur").otherwise("mineur")
    rows = e.select(
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("finding_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 40).alias("page_id"), ((F.col("event_id") * 7) % _N).alias("k"),
        severity.alias("severity"), (F.col("event_id") % 5 == 0).alias("advisory"), F.col("event_type").alias("rule_id"), (F.col("event_id") % 300).cast("int").alias("line"), "value",
    )
    return rows.join(dim, "k").drop("k")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string")).alias("subject"), F.concat_ws("|", "event_type", (F.col("event_id") % 13).cast("string")).alias("cls"),
        (F.col("user_id") % 40).alias("page_id"), F.col("event_id").alias("ord"),
    )


_EV = "ev AS (SELECT 's' || user_id % 9 AS subject, event_type || '|' || event_id % 13 AS cls, user_id % 40 AS page_id, event_id AS ord FROM events)"


@query(
    f"{_WITH}, {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, cls ORDER BY page_id, ord) AS nth FROM ev), "
    "c AS (SELECT subject, cls, count(*) AS occurrences, count(DISTINCT page_id) AS pages, min(page_id) FILTER (nth = 1) AS page_id, min(ord) FILTER (nth = 1) AS ord, "
    "coalesce(string_agg(page_id || ':' || ord, ' ' ORDER BY nth) FILTER (nth BETWEEN 2 AND 9), '') AS also_at FROM r GROUP BY 1, 2), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY occurrences DESC, cls) AS place, greatest(count(*) OVER (PARTITION BY subject) - 50, 0) AS left_out FROM c) "
    "SELECT s.sc, p.subject, p.cls, p.occurrences, p.pages, p.page_id, p.ord, p.also_at, p.left_out FROM s JOIN p ON p.subject = 's' || s.k % 9 WHERE s.status = 'manual' AND p.place <= 50"
)
def review_worklist(spark, sf_dir):
    criteria = _criteria(spark)
    subjects = criteria.select("sc", F.concat(F.lit("s"), (F.col("k") % 9).cast("string")).alias("subject"))
    return review.worklist(criteria, subjects, _evidence(spark, sf_dir), most_classes=50)


@query(f"{_WITH}, o AS (SELECT row_number() OVER (ORDER BY {_RANK}, sc, page_id, line, finding_id) AS n, * FROM f WHERE NOT advisory) SELECT CAST(n AS INTEGER) AS n, finding_id, sc, page_id, line, severity FROM o WHERE n <= 40")
def review_verify_list(spark, sf_dir):
    return review.verify_list(_findings(spark, sf_dir))


@query(f"WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, subject ORDER BY ord) AS nth FROM ev) SELECT page_id, subject, cls, ord FROM r WHERE nth <= 3")
def review_first_of_subject(spark, sf_dir):
    return review.first_of_subject(_evidence(spark, sf_dir), 3).select("page_id", "subject", "cls", "ord")


_VERDICTS = (
    "v AS (SELECT sc, CASE count(*) FILTER (value > 20) % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'NC' WHEN 2 THEN 'NA' ELSE 'unsure' END AS verdict, CASE WHEN count(*) FILTER (value < 5) % 2 = 0 THEN 'agent' ELSE 'human' END AS decided_by FROM f GROUP BY sc), "
    "b AS (SELECT sc FROM f GROUP BY sc HAVING count(*) FILTER (value > 30) % 5 = 0), "
    "d AS (SELECT s.sc, s.status = 'manual' AND v.verdict IN ('C', 'NC', 'NA') AND b.sc IS NULL AS taken, s.status AS was, v.verdict, v.decided_by AS who FROM s LEFT JOIN v ON v.sc = s.sc LEFT JOIN b ON b.sc = s.sc), "
    "z AS (SELECT sc, CASE WHEN taken THEN verdict ELSE was END AS status, CASE WHEN taken THEN who WHEN was <> 'manual' THEN 'engine' END AS decided_by FROM d)"
)


def _verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = lambda c, m: F.count_if(c) % m
    by = _findings(spark, sf_dir).groupBy("sc").agg(n(F.col("value") > 20, 4).alias("a"), n(F.col("value") < 5, 2).alias("h"), n(F.col("value") > 30, 5).alias("b"))
    verdict = F.when(F.col("a") == 0, "C").when(F.col("a") == 1, "NC").when(F.col("a") == 2, "NA").otherwise("unsure")
    return by.select("sc", verdict.alias("verdict"), F.when(F.col("h") == 0, "agent").otherwise("human").alias("decided_by")), by.where("b = 0").select("sc", F.lit("x").alias("violation"))


@query(f"{_WITH}, {_VERDICTS} SELECT sc, status, decided_by FROM z")
def review_folded(spark, sf_dir):
    return review.folded(_criteria(spark), *_verdicts(spark, sf_dir))


@query(f"{_WITH}, {_VERDICTS} SELECT sc, CASE WHEN (SELECT count(*) FROM b) = 0 THEN status ELSE was END AS status FROM z JOIN d USING (sc)")
def review_folded_strictly(spark, sf_dir):
    return review.folded(_criteria(spark), *_verdicts(spark, sf_dir), strict=True).select("sc", "status")


@query(f"{_WITH}, {_VERDICTS}, c AS (SELECT count(*) FILTER (status = 'C' AND coalesce(decided_by, 'engine') IN ('engine', 'scan')) AS conforming, count(*) FILTER (status = 'NC') AS nc FROM z) SELECT conforming, conforming + nc AS decided, CAST(floor(100.0 * conforming / (conforming + nc) + 0.5) AS BIGINT) AS pct FROM c")
def review_automatic_rate(spark, sf_dir):
    return review.automatic_rate(review.folded(_criteria(spark), *_verdicts(spark, sf_dir)))


@query(f"{_WITH}, {_VERDICTS} SELECT count(*) FILTER (decided_by = 'engine') AS engine, count(*) FILTER (decided_by = 'scan') AS scan, count(*) FILTER (decided_by = 'agent') AS agent, count(*) FILTER (decided_by = 'human') AS human FROM z WHERE status <> 'manual'")
def review_provenance(spark, sf_dir):
    return review.provenance(review.folded(_criteria(spark), *_verdicts(spark, sf_dir)))


_SCALE = [("low", 10), ("half", 50), ("full", 100)]


@query(
    f"{_WITH}, {_VERDICTS}, l AS ({values('name VARCHAR, least INTEGER', _SCALE)}), t AS (SELECT count(*) FILTER (status = 'C') AS c, count(*) FILTER (status IN ('C', 'NC', 'manual')) AS a FROM z) "
    "SELECT name, least, c >= ceil(least * a / 100.0) AS reached, CAST(greatest(ceil(least * a / 100.0) - c, 0) AS BIGINT) AS missing FROM l, t"
)
def review_levels(spark, sf_dir):
    return review.levels(review.folded(_criteria(spark), *_verdicts(spark, sf_dir)), spark.createDataFrame(_SCALE, "name string, least int"))


@query(f"{_WITH}, {_VERDICTS} SELECT v.sc, v.verdict FROM v WHERE v.sc IN (SELECT sc FROM f WHERE page_id = 7)")
def review_on_page(spark, sf_dir):
    found = _findings(spark, sf_dir)
    return review.on_page(_verdicts(spark, sf_dir)[0], found.select("sc", "page_id"), 7).select("sc", "verdict")


_SCAN = "a AS (SELECT * FROM f WHERE seq % 2 = 0), c AS (SELECT * FROM f WHERE seq % 3 = 0 AND value > 25), u AS (SELECT * FROM a UNION ALL SELECT * FROM c WHERE finding_id NOT IN (SELECT finding_id FROM a)), n AS (SELECT sc, count(*) FILTER (NOT advisory) AS n FROM u GROUP BY sc)"


def _scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = _findings(spark, sf_dir)
    return review.merged_scan(_criteria(spark), found.where("seq % 2 = 0"), found.where("seq % 3 = 0 and value > 25"))


@query(f"{_WITH}, {_SCAN} SELECT s.sc, CASE WHEN n.n > 0 THEN 'NC' ELSE s.status END AS status, s.inapplicable AND coalesce(n.n, 0) = 0 AS inapplicable FROM s LEFT JOIN n USING (sc)")
def review_scan_merge(spark, sf_dir):
    return _scan(spark, sf_dir)[0]


@query(f"{_WITH}, {_SCAN} SELECT sc, severity, count(*) AS n FROM u GROUP BY 1, 2")
def review_scan_findings(spark, sf_dir):
    return _scan(spark, sf_dir)[1].groupBy("sc", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{_WITH}, o AS (SELECT sc, CASE k % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'C' ELSE 'NC' END AS t, k % 7 = 1 AS j FROM s WHERE k % 5 <> 0), m AS (SELECT s.sc, status, inapplicable, t, j FROM s LEFT JOIN o USING (sc)) "
    "SELECT sc, CASE WHEN status = 'NC' OR t = 'NC' THEN 'NC' WHEN inapplicable AND t IS NOT NULL THEN t WHEN t IS NULL OR j THEN status WHEN status = 'manual' OR t = 'manual' THEN 'manual' ELSE 'C' END AS status, "
    "inapplicable AND coalesce(j, TRUE) AND NOT (status = 'NC' OR coalesce(t, '') = 'NC') AS inapplicable FROM m"
)
def review_audit_merge(spark, sf_dir):
    first = _criteria(spark)
    other = F.when(F.col("k") % 3 == 0, "manual").when(F.col("k") % 3 == 1, "C").otherwise("NC")
    second = first.where("k % 5 <> 0").select("sc", other.alias("status"), (F.col("k") % 7 == 1).alias("inapplicable"))
    return review.merged_audits(first, second)


_WITHDRAWN = "x AS (SELECT finding_id FROM f JOIN s USING (sc) WHERE s.k % 8 = 1 OR f.value > 30), l AS (SELECT * FROM f WHERE finding_id NOT IN (SELECT finding_id FROM x)), n AS (SELECT sc, count(*) FILTER (NOT advisory) AS n FROM l GROUP BY sc)"


@query(f"{_WITH}, {_WITHDRAWN} SELECT s.sc, CASE WHEN status = 'NC' AND coalesce(n.n, 0) = 0 AND sc IN (SELECT sc FROM f JOIN x USING (finding_id)) THEN 'manual' ELSE status END AS status FROM s LEFT JOIN n USING (sc)")
def review_withdrawn(spark, sf_dir):
    criteria, found = _criteria(spark), _findings(spark, sf_dir)
    refuted = found.join(criteria.select("sc", "k"), "sc").where("k % 8 = 1 or value > 30").select("finding_id")
    return review.withdrawn(criteria, found, refuted)[0]


@query(f"{_WITH} SELECT finding_id, row_number() OVER (ORDER BY {_RANK}, m, page_id, seq) AS place FROM (SELECT *, min(seq) OVER (PARTITION BY severity, page_id) AS m FROM f)")
def review_merged_order(spark, sf_dir):
    return review.merged_order(_findings(spark, sf_dir)).select("finding_id", "place")


_PACK = "x AS (SELECT 'p' || k % 20 AS id, sc FROM k), p(id, pattern) AS (VALUES ('p1', 'click'), ('p2', 'view'), ('p3', '*'))"


@query(
    f"{_WITH}, {_PACK}, e AS (SELECT DISTINCT f.finding_id FROM f JOIN x USING (sc) WHERE x.id NOT IN (SELECT id FROM p) OR EXISTS (SELECT 1 FROM p WHERE p.id = x.id AND p.pattern IN ('*', f.rule_id))) "
    "SELECT rule_id, rule_id = 'error' OR (rule_id <> 'signup' AND advisory) AS advisory, count(*) AS n FROM f JOIN e USING (finding_id) GROUP BY 1, 2"
)
def review_for_standard(spark, sf_dir):
    crosswalk = _criteria(spark).select(F.concat(F.lit("p"), (F.col("k") % 20).cast("string")).alias("id"), "sc")
    applies = spark.createDataFrame([("p1", "click"), ("p2", "view"), ("p3", "*")], "id string, pattern string")
    overrides = spark.createDataFrame([("error", True), ("signup", False)], "rule_id string, advisory boolean")
    return review.findings_for(_findings(spark, sf_dir), crosswalk, applies, overrides).groupBy("rule_id", "advisory").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_WITH}, {_VERDICTS}, c AS (SELECT split_part(sc, '.', 1) AS theme, count(*) FILTER (status = 'C') AS conforming, count(*) FILTER (status = 'NC') AS failing, count(*) FILTER (status = 'manual') AS open FROM z GROUP BY 1) SELECT *, CAST(CASE WHEN conforming + failing = 0 THEN 100 ELSE floor(100.0 * conforming / (conforming + failing) + 0.5) END AS BIGINT) AS pct FROM c")
def pack_themes(spark, sf_dir):
    rows = review.folded(_criteria(spark), *_verdicts(spark, sf_dir))
    return review.rates_by(rows.withColumn("theme", F.split("sc", "[.]")[0]), "theme")


_OUTSIDE = (
    "a AS (SELECT page_id AS page, sc AS criterion, count(*) AS f1 FROM f WHERE seq % 3 <> 0 AND value > 24 GROUP BY 1, 2), b AS (SELECT page_id AS page, sc AS criterion, count(*) FILTER (value > 24) AS f2, max(seq % 11) > 4 AS t2 FROM f WHERE seq % 2 = 0 GROUP BY 1, 2), "
    "j AS (SELECT page, criterion, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, coalesce(t2, FALSE) AS t2 FROM a FULL JOIN b USING (page, criterion))"
)


@query(f"{_WITH}, {_OUTSIDE} SELECT page, criterion, CASE WHEN f1 > 0 AND NOT t2 THEN 'not retested' WHEN f1 > 0 AND f2 = 0 THEN 'fixed' WHEN f1 > 0 AND f2 < f1 THEN 'partially fixed' WHEN f2 > f1 THEN 'regressed' ELSE 'unchanged' END AS bucket FROM j WHERE f1 > 0 OR f2 > 0")
def external_diff(spark, sf_dir):
    found = _findings(spark, sf_dir).withColumnsRenamed({"page_id": "page", "sc": "criterion"})
    earlier = found.where("seq % 3 <> 0 and value > 24").groupBy("page", "criterion").agg(F.count(F.lit(1)).alias("failures"))
    now = found.where("seq % 2 = 0").groupBy("page", "criterion").agg(F.count_if(F.col("value") > 24).alias("failures"), (F.max(F.col("seq") % 11) > 4).alias("tested"))
    return review.external_diff(earlier, now)


@query(f"WITH {_EV}, c AS (SELECT page_id, count(*) AS occurrences FROM ev WHERE subject = 's3' GROUP BY 1) SELECT page_id, occurrences, CAST(row_number() OVER (ORDER BY occurrences DESC, (page_id * 17) % 41) AS INTEGER) AS place FROM c")
def review_occurrences(spark, sf_dir):
    evidence = _evidence(spark, sf_dir).where("subject = 's3'")
    pages = evidence.select("page_id").distinct().withColumn("position", (F.col("page_id") * 17) % 41)
    return review.occurrences_by_page(evidence, pages)


@query(f"{_WITH} SELECT sc, CASE min(CASE rule_id WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 END) WHEN 1 THEN 'view' WHEN 2 THEN 'click' ELSE 'signup' END AS tier FROM f WHERE rule_id IN ('view', 'click', 'signup') AND value > 40 GROUP BY sc")
def review_cheapest_tier(spark, sf_dir):
    return review.cheapest_tier(_findings(spark, sf_dir).where("value > 40").select("sc", F.col("rule_id").alias("tier")), ["view", "click", "signup"])


@query(f"{_WITH} SELECT how AS tier, count(*) AS n FROM k GROUP BY 1")
def review_tier_census(spark, sf_dir):
    return review.tier_census(_criteria(spark))


@query(f"{_WITH} SELECT sc, level FROM k WHERE level = 'AA' AND sc LIKE '1.4.%'")
def review_criteria_view(spark, sf_dir):
    return review.criteria_view(_criteria(spark), "AA", "1.4").select("sc", "level")


_FILES = "c AS (SELECT DISTINCT 'app/part' || user_id % 30 || '/' || event_type || '.tsx' AS file, 'C' || user_id % 3 AS name, user_id % 4 = 0 AS has_control, user_id % 5 = 0 AS opaque FROM events), p AS (SELECT DISTINCT 'part' || user_id % 30 || '/' || event_type || '.tsx' AS source, CASE WHEN user_id % 2 = 0 THEN 'C' || user_id % 3 END AS component FROM events WHERE value > 45)"


@query(f"WITH {_FILES} SELECT file, name, bool_or(p.source IS NOT NULL) AS covered FROM (SELECT DISTINCT file, name FROM c WHERE has_control OR opaque) q LEFT JOIN p ON q.file = 'app/' || p.source AND (p.component IS NULL OR p.component = q.name) GROUP BY 1, 2")
def capture_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    part = F.concat(F.lit("part"), (F.col("user_id") % 30).cast("string"), F.lit("/"), F.col("event_type"), F.lit(".tsx"))
    name = F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string"))
    components = e.select(F.concat(F.lit("app/"), part).alias("file"), name.alias("name"), (F.col("user_id") % 4 == 0).alias("has_control"), (F.col("user_id") % 5 == 0).alias("opaque")).distinct()
    captures = e.where("value > 45").select(part.alias("source"), F.when(F.col("user_id") % 2 == 0, name).alias("component")).distinct()
    return review.capture_coverage(components, captures)


@query("WITH o AS (SELECT row_number() OVER (ORDER BY o_custkey % 3, o_orderkey) AS n FROM orders) SELECT least(count(*), 500) AS read, greatest(count(*) - 500, 0) AS left_out FROM o")
def files_limited(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("tier"), F.col("o_orderkey").alias("path"))
    return review.limited_files(files, 500)[1]


_CITES = (
    "c AS (SELECT page_id, html, len(string_split(html, chr(10))) AS n, CASE page_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'range' WHEN 2 THEN 'file' ELSE 'good' END AS kind FROM pages)"
)


@query(f"WITH {_CITES} SELECT page_id AS citation, CASE kind WHEN 'file' THEN 'no-file' WHEN 'range' THEN 'out-of-range' WHEN 'missing' THEN 'missing' ELSE 'found' END AS state FROM c")
def review_grounded(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 5
    snippet = F.when(kind == 0, "no page says ¤ this").otherwise(F.regexp_extract("html", "<title>([^<]*)", 1))
    line = F.when(kind == 1, F.size(F.split("html", "\n")) + 1).otherwise(F.lit(1))
    citations = pages.select(F.col("page_id").alias("citation"), F.when(kind == 2, "nowhere").otherwise(F.col("page_id").cast("string")).alias("file"), line.alias("line"), snippet.alias("snippet"))
    return review.grounded(citations, pages.select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("source")))


# --- integrity checks


@query(f"{_WITH}, n AS (SELECT DISTINCT sc FROM f WHERE value > 60) SELECT coalesce(n.sc, s.sc) AS id, CASE WHEN n.sc IS NULL THEN 'omitted' ELSE 'invented' END AS state FROM n FULL JOIN (SELECT sc FROM s WHERE status = 'NC') s ON s.sc = n.sc WHERE n.sc IS NULL OR s.sc IS NULL")
def check_report(spark, sf_dir):
    reported = _findings(spark, sf_dir).where("value > 60").select(F.col("sc").alias("id"))
    return checks.report_differs(reported, _criteria(spark).withColumnRenamed("sc", "id"))


@query(f"{_WITH}, t AS (SELECT status, count(*) AS counted FROM s GROUP BY 1), g AS (SELECT CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'NC' WHEN 'error' THEN 'manual' END AS status, count(*) % 29 AS n FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1) SELECT status, coalesce(n, 0) AS stated, coalesce(counted, 0) AS counted FROM g FULL JOIN t USING (status) WHERE coalesce(n, 0) <> coalesce(counted, 0)")
def check_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "C").when(F.col("event_type") == "view", "NC").when(F.col("event_type") == "error", "manual")
    stated = e.select(status.alias("status")).where("status is not null").groupBy("status").agg((F.count(F.lit(1)) % 29).alias("n"))
    return checks.totals_differ(stated, _criteria(spark))


_ALLOWED = "w AS (SELECT sc, CASE WHEN count(*) FILTER (value > 50) % 3 = 0 THEN ' ' ELSE 'why' END AS reason FROM f GROUP BY sc HAVING count(*) FILTER (value > 20) % 2 = 0)"


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _findings(spark, sf_dir).groupBy("sc").agg((F.count_if(F.col("value") > 50) % 3).alias("a"), (F.count_if(F.col("value") > 20) % 2).alias("b"))
    return by.where("b = 0").select("sc", F.when(F.col("a") == 0, " ").otherwise("why").alias("reason"))


@query(
    f"{_WITH}, {_ALLOWED} SELECT sc, 'open' AS violation FROM s WHERE status = 'manual' AND sc NOT IN (SELECT sc FROM w WHERE reason = 'why') UNION ALL SELECT sc, 'no-reason' FROM w WHERE reason = ' ' "
    "UNION ALL SELECT sc, 'needless' FROM w WHERE reason = 'why' AND sc NOT IN (SELECT sc FROM s WHERE status = 'manual')"
)
def check_decided(spark, sf_dir):
    return checks.undecided(_criteria(spark), _allowed(spark, sf_dir))


@query(f"{_WITH}, {_ALLOWED} SELECT sc FROM s WHERE status = 'manual' AND how = 'needs-rendering' AND sc NOT IN (SELECT sc FROM w WHERE reason = 'why') AND NOT EXISTS (SELECT 1 FROM events WHERE value < 0)")
def check_rendered(spark, sf_dir):
    snapshots = table(spark, sf_dir, "events").where("value < 0").select(F.col("event_id").alias("page_id"))
    return checks.unrendered(_criteria(spark), snapshots, _allowed(spark, sf_dir))


_IDS = "d AS (SELECT c_custkey AS position, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE 'page-' || c_custkey % 90 END AS id, CASE WHEN c_custkey % 33 = 0 THEN NULL ELSE c_name END AS name, CASE c_custkey % 7 WHEN 0 THEN 'https://x.example/' || c_custkey WHEN 1 THEN './a.html' WHEN 2 THEN ' ' WHEN 3 THEN 'ftp:thing' ELSE '/p/' || c_custkey END AS url FROM customer)"


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    url = F.when(key % 7 == 0, F.concat(F.lit("https://x.example/"), key.cast("string"))).when(key % 7 == 1, "./a.html").when(key % 7 == 2, " ").when(key % 7 == 3, "ftp:thing").otherwise(F.concat(F.lit("/p/"), key.cast("string")))
    ident = F.when(key % 50 == 0, "").otherwise(F.concat(F.lit("page-"), (key % 90).cast("string")))
    return c.select(key.alias("position"), ident.alias("id"), F.when(key % 33 != 0, F.col("c_name")).alias("name"), url.alias("url"))


@query(
    f"WITH {_IDS} SELECT position, 'no id' AS problem FROM d WHERE id = '' UNION ALL SELECT position, 'duplicate id' FROM (SELECT position, row_number() OVER (PARTITION BY id ORDER BY position) AS n FROM d WHERE id <> '') WHERE n > 1 "
    "UNION ALL SELECT position, 'no name' FROM d WHERE name IS NULL UNION ALL SELECT position, 'no url' FROM d WHERE trim(url) = '' UNION ALL SELECT position, 'malformed url' FROM d WHERE url LIKE 'ftp%'"
)
def sample_problems(spark, sf_dir):
    return checks.sample_problems(_declared(spark, sf_dir))


_KINDS = [("home", "Customer#000000001"), ("contact", "kontakt"), ("help", "faq"), ("search", "x.exämple"), ("representative", "zzz"), ("form", "form")]


@query(f"WITH q AS ({values('kind VARCHAR, keyword VARCHAR', _KINDS)}) SELECT kind FROM q WHERE NOT EXISTS (SELECT 1 FROM customer WHERE contains(lower(c_name) || ' https://x.example/', replace(lower(keyword), 'ä', 'a'))) AND kind <> 'representative'")
def sample_missing_kinds(spark, sf_dir):
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("https://x.example/").alias("url"), F.lit(None).cast("string").alias("notes"))
    return checks.missing_kinds(pages, spark.createDataFrame(_KINDS, "kind string, keyword string"))


@query("SELECT id, CASE WHEN NOT d THEN 'undeclared' WHEN NOT c THEN 'uncaptured' ELSE 'both' END AS state FROM (SELECT id, bool_or(d) AS d, bool_or(NOT d) AS c FROM (SELECT DISTINCT 'u' || user_id AS id, TRUE AS d FROM events WHERE event_type = 'signup' UNION ALL SELECT DISTINCT 'u' || user_id, FALSE FROM events WHERE event_type = 'purchase') GROUP BY id)")
def sample_drift(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ids = lambda kind: e.where(F.col("event_type") == kind).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"))
    return checks.sample_drift(ids("signup"), ids("purchase"))


@query("SELECT DISTINCT 'u' || user_id AS id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def sample_uncaptured(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ids = lambda kind: e.where(F.col("event_type") == kind).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id")).distinct()
    return checks.uncaptured(ids("signup"), ids("purchase"))


@query(
    "WITH d AS (SELECT page_id, 'p' || page_id AS id, url FROM pages WHERE page_id % 2 = 0), n AS (SELECT url, min(page_id) AS position FROM pages WHERE url NOT IN (SELECT url FROM d) GROUP BY url), "
    "m AS (SELECT 0 AS o, page_id AS position, id, url FROM d UNION ALL SELECT 1, position, 'p' || (position - position % 7), url FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, position) AS n FROM m) "
    "SELECT position, CASE WHEN n = 1 THEN id ELSE id || '-' || n END AS id, CASE WHEN o = 0 THEN 'kept' ELSE 'added' END AS state FROM r"
)
def sample_merged(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    name = lambda key: F.concat(F.lit("p"), key.cast("string"))
    declared = pages.where("page_id % 2 = 0").select(name(F.col("page_id")).alias("id"), F.col("url").alias("name"), "url", F.col("page_id").alias("position"))
    proposed = pages.select(name(F.col("page_id") - F.col("page_id") % 7).alias("id"), F.col("url").alias("name"), "url", F.col("page_id").alias("position"))
    return checks.merged_sample(declared, proposed).select("position", "id", "state")


@query("SELECT kind, item, count(*) AS times FROM (SELECT DISTINCT event_type AS kind, user_id AS item, event_id % 2 AS run FROM events) GROUP BY 1, 2")
def scope_union(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    run = lambda n: e.where(F.col("event_id") % 2 == n).select(F.col("event_type").alias("kind"), F.col("user_id").alias("item"))
    return checks.united_scope(run(0), run(1))


_AXE = "n AS (SELECT user_id % 40 AS page_id, event_type AS rule, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' ELSE 'minor' END AS impact, event_id AS i FROM events)"


@query(f"WITH {_AXE}, t AS (SELECT *, unnest(CASE i % 3 WHEN 0 THEN ['1.1.1', '4.1.2'] WHEN 1 THEN ['1.4.10'] ELSE [] END) AS sc FROM n) SELECT page_id, 'axe:' || rule AS rule_id, sc, CASE impact WHEN 'critical' THEN 'bloquant' WHEN 'serious' THEN 'majeur' ELSE 'mineur' END AS severity, count(*) AS n FROM t GROUP BY ALL")
def axe_findings(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    tags = F.when(i % 3 == 0, F.array(F.lit("wcag2a"), F.lit("wcag111"), F.lit("wcag412"), F.lit("wcag111"))).when(i % 3 == 1, F.array(F.lit("best-practice"), F.lit("wcag1410"))).otherwise(F.array(F.lit("wcag21aa")))
    impact = F.when(i % 4 == 0, "critical").when(i % 4 == 1, "serious").otherwise("minor")
    nodes = e.select((F.col("user_id") % 40).alias("page_id"), F.col("event_type").alias("rule"), impact.alias("impact"), tags.alias("tags"), F.lit("html").alias("target"))
    return checks.axe_findings(nodes).groupBy("page_id", "rule_id", "sc", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("WITH g AS (SELECT DISTINCT user_id % 60 AS page_id FROM events), q AS (SELECT DISTINCT user_id % 60 AS page_id, event_type AS sc FROM events), h AS (SELECT event_type AS sc, count(*) AS hits FROM events WHERE value > 30 AND event_type IN ('click', 'view') GROUP BY 1) SELECT q.sc, coalesce(any_value(h.hits), 0) AS hits, coalesce(any_value(h.hits), 0) = 0 AND count(DISTINCT q.page_id) = (SELECT count(*) FROM g) AS proven FROM q LEFT JOIN h USING (sc) GROUP BY q.sc")
def probe_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("page_id"), F.col("event_type").alias("sc"), "value")
    return checks.probe_outcomes(rows.select("page_id", "sc"), rows.where("value > 30 and sc in ('click', 'view')").select("page_id", "sc"), rows.select("page_id"))


@query(f"{_WITH} SELECT finding_id, rule_id FROM f WHERE seq % 4 < 3")
def findings_union(spark, sf_dir):
    """Two runs that overlap: each finding once."""
    found = _findings(spark, sf_dir)
    return changes.union_of(found.where("seq % 4 < 2"), found.where("seq % 4 in (1, 2)")).select("finding_id", "rule_id")


@query(f"{_WITH}, b AS (SELECT page_id, rule_id AS key, count(*) + 3 AS n FROM f WHERE seq % 2 = 0 GROUP BY 1, 2), c AS (SELECT page_id, rule_id AS key, count(*) AS now FROM f WHERE page_id % 3 = 0 AND seq % 2 = 0 GROUP BY 1, 2) SELECT b.page_id, CAST(sum(greatest(b.n - coalesce(c.now, 0), 0)) AS BIGINT) AS fixed FROM b LEFT JOIN c USING (page_id, key) WHERE b.page_id IN (SELECT page_id FROM c) GROUP BY 1")
def findings_vanished(spark, sf_dir):
    found = _findings(spark, sf_dir).where("seq % 2 = 0").withColumnRenamed("rule_id", "key")
    earlier = found.groupBy("page_id", "key").agg((F.count(F.lit(1)) + 3).alias("n"))
    return changes.vanished(found.where("page_id % 3 = 0"), earlier)


@query(f"{_WITH}, {_VERDICTS} SELECT sc, verdict FROM v UNION ALL SELECT sc, 'old' FROM k WHERE sc NOT IN (SELECT sc FROM v WHERE verdict <> 'unsure') AND sc NOT IN (SELECT sc FROM v WHERE verdict = 'unsure')")
def ledger_merged(spark, sf_dir):
    fresh = _verdicts(spark, sf_dir)[0].select("sc", "verdict")
    return changes.merged_ledger(_criteria(spark).select("sc", F.lit("old").alias("verdict")), fresh)


# --- tickets and stored citations

_PLAN = (
    "t AS (SELECT sc, CASE WHEN page_id % 7 <> 0 THEN 'p' || page_id END AS page, 'f' || seq % 23 AS file, severity, advisory FROM f), "
    f"g AS (SELECT sc, page, file, grouping(sc) AS a, grouping(page) AS b, grouping(file) AS c, count(*) AS occurrences, min({_RANK}) AS worst, bool_and(advisory) AS advisory FROM t GROUP BY GROUPING SETS ((sc), (page), (page, sc), (file), ())), "
    "n AS (SELECT CASE WHEN a = 0 AND b = 0 THEN 'page-criterion' WHEN a = 0 THEN 'criterion' WHEN b = 0 THEN 'page' WHEN c = 0 THEN 'file' ELSE 'single' END AS grain, * FROM g WHERE b = 1 OR page IS NOT NULL)"
)


@query(f"{_WITH}, {_PLAN} SELECT grain, sc, page, file, concat_ws(' ', grain, page, sc, file) AS title, occurrences, CASE worst WHEN 0 THEN 'bloquant' WHEN 1 THEN 'majeur' ELSE 'mineur' END AS severity, advisory FROM n")
def review_ticket_plan(spark, sf_dir):
    """The tickets of all five grains."""
    found = _findings(spark, sf_dir)
    page = F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("p"), F.col("page_id").cast("string")))
    return verdicts.ticket_plan(found.select("sc", page.alias("page"), F.concat(F.lit("f"), (F.col("seq") % 23).cast("string")).alias("file"), "severity", "advisory"))


#: Stored anchors are orders; today's evidence has them moved, gone, or joined by others on their line.
_ANCHORS = (
    "o AS (SELECT o_orderkey AS k, 'c' || o_custkey % 9 AS sc FROM orders), "
    "old AS (SELECT k AS nr, sc, CASE WHEN k % 6 = 0 THEN '/old/run/shots/pages/p' || k % 5 || '/dom.html' ELSE '/old/src/f' || k % 40 || '.html' END AS file, CASE WHEN k % 6 = 0 THEN 'shots/pages/p' || k % 5 || '/dom.html' ELSE 'src/f' || k % 40 || '.html' END AS id, "
    "k % 300 AS line, CASE WHEN k % 2 = 0 THEN 'a' ELSE '' END AS sel, 'text ' || k % 70 AS txt FROM o), "
    "now AS (SELECT k AS seq, sc, CASE WHEN k % 6 = 0 THEN 'shots/pages/p' || k % 5 || '/dom.html' ELSE 'src/f' || k % 40 || '.html' END AS file, k % 300 + k % 3 AS line, CASE WHEN k % 2 = 0 THEN 'a' ELSE '' END AS sel, 'text ' || k % 70 AS txt FROM o WHERE k % 4 <> 0 "
    "UNION ALL SELECT k + 10000000, sc, 'src/f' || k % 40 || '.html', k % 300, 'b', CASE WHEN k % 8 = 0 THEN 'text ' || k % 70 ELSE 'other' END FROM o WHERE k % 4 = 0 AND k % 6 <> 0), "
    "e1 AS (SELECT sc, file, sel, txt, max_by(line, seq) AS line FROM now GROUP BY ALL), e2 AS (SELECT sc, file, line, count(*) AS n FROM now GROUP BY ALL), e3 AS (SELECT sc, file, line, txt FROM now GROUP BY ALL)"
)


@query(
    f"WITH {_ANCHORS} SELECT nr AS \"at\", CASE WHEN e1.line IS NOT NULL OR e2.n = 1 OR e3.txt IS NOT NULL OR CAST(regexp_extract(old.id, '[fp]([0-9]+)[./]', 1) AS INTEGER) < 30 THEN old.id ELSE old.file END AS file, "
    "CAST(coalesce(e1.line, old.line) AS INTEGER) AS line, CASE WHEN e1.line IS NOT NULL THEN 'exact' WHEN e2.n = 1 THEN 'place' WHEN e3.txt IS NOT NULL THEN 'text' WHEN CAST(regexp_extract(old.id, '[fp]([0-9]+)[./]', 1) AS INTEGER) < 30 THEN 'file' ELSE 'kept' END AS how "
    "FROM old LEFT JOIN e1 ON e1.sc = old.sc AND e1.file = old.id AND e1.sel = old.sel AND e1.txt = old.txt LEFT JOIN e2 ON e2.sc = old.sc AND e2.file = old.id AND e2.line = old.line "
    "LEFT JOIN e3 ON e3.sc = old.sc AND e3.file = old.id AND e3.line = old.line AND e3.txt = old.txt"
)
def review_reanchored(spark, sf_dir):
    """Where stored citations stand in today's evidence."""
    k = F.col("k")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text("c", F.col("o_custkey") % 9).alias("sc"))
    shot, file = text("shots/pages/p", k % 5, "/dom.html"), text("src/f", k % 40, ".html")
    sel, said = F.when(k % 2 == 0, "a"), text("text ", k % 70)
    line = (k % 300).cast("int")
    stored = rows.select(k.alias("at"), "sc", F.when(k % 6 == 0, text("/old/run/", shot)).otherwise(text("/old/", file)).alias("file"), line.alias("line"), sel.alias("selector"), said.alias("snippet"))
    kept = rows.where(k % 4 != 0).select(k.alias("seq"), "sc", F.when(k % 6 == 0, shot).otherwise(file).alias("file"), (line + k % 3).cast("int").alias("line"), sel.alias("selector"), F.concat(F.lit(" "), said, F.lit("\n")).alias("snippet"))
    new = rows.where((k % 4 == 0) & (k % 6 != 0)).select((k + 10000000).alias("seq"), "sc", file.alias("file"), line.alias("line"), F.lit("b").alias("selector"), F.when(k % 8 == 0, said).otherwise("other").alias("snippet"))
    known = spark.range(40).where("id < 30").select(text("src/f", F.col("id"), ".html").alias("file")).unionByName(spark.range(5).select(text("shots/pages/p", F.col("id"), "/dom.html").alias("file")))
    return ledger.reanchored(stored, kept.unionByName(new), known, "shots/pages", root="/old")


# --- the criteria of a standards pack, made from customers

_SCS = "[" + ", ".join(f"'{sc}'" for sc, *_ in _DIM) + "]"
_MATCH = "(p = '*' OR rule_id = p OR (p LIKE '%-*' AND starts_with(rule_id, left(p, length(p) - 1))))"
_RESULTS = (
    f"q AS (SELECT c_custkey AS k, 'k' || c_custkey AS id, c_custkey % 7 AS theme, CASE WHEN c_custkey % 29 = 0 THEN ['9.9.9'] ELSE list_distinct([{_SCS}[c_custkey % {_N} + 1], {_SCS}[(c_custkey * 3 + 1) % {_N} + 1]]) END AS wcag, "
    "CASE c_custkey % 4 WHEN 1 THEN ['click-0', 'view-1'] WHEN 2 THEN ['error-*'] WHEN 3 THEN ['signup-2', 'click-1'] END AS patterns, c_custkey % 31 = 0 AS own, c_custkey % 6 = 0 AS judged, CASE c_custkey % 5 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS silent FROM customer), "
    "fs AS (SELECT sc, rule_id || '-' || seq % 3 AS rule_id, advisory FROM f WHERE seq % 97 = 0), fo AS (SELECT sc, rule_id, CASE rule_id WHEN 'view-1' THEN TRUE WHEN 'click-1' THEN FALSE ELSE advisory END AS advisory FROM fs), "
    "mp AS (SELECT k, patterns, silent, unnest(wcag) AS sc FROM q), "
    "fa AS (SELECT mp.k, count(s.sc) AS held, coalesce(bool_or(s.status = 'NC'), FALSE) AS nc, coalesce(bool_or(s.status = 'manual'), FALSE) AS op, coalesce(bool_or(s.status = 'C' AND NOT s.inapplicable), FALSE) AS c, coalesce(bool_and(s.inapplicable), TRUE) AS idle, bool_and(mp.sc = '9.9.9') AS outside FROM mp LEFT JOIN s ON s.sc = mp.sc GROUP BY mp.k), "
    f"pr AS (SELECT mp.k, silent, rule_id, advisory, CASE WHEN rule_id = 'click-0' THEN 'decisive-nc' WHEN rule_id LIKE 'click-%' THEN 'candidate' ELSE 'decisive-nc' END AS effect FROM mp JOIN fo ON fo.sc = mp.sc WHERE patterns IS NOT NULL AND len(list_filter(patterns, lambda p: {_MATCH})) > 0), "
    "hi AS (SELECT k, count(*) FILTER (NOT advisory AND (silent IS NULL OR effect = 'decisive-nc')) AS normative, count(*) FILTER (NOT advisory AND silent IS NOT NULL AND effect = 'candidate') AS candidates FROM pr GROUP BY k), "
    "z0 AS (SELECT q.*, coalesce(normative, 0) AS normative, coalesce(candidates, 0) AS candidates, held, nc, op, c, idle, outside AND NOT own AS unaudited, CASE WHEN nc THEN 'NC' WHEN c THEN 'C' WHEN op THEN 'manual' ELSE 'C' END AS summed, k % 8 = 3 AS absent, k % 9 = 1 AS seen, silent IS NOT NULL AND NOT silent AS unproven FROM q JOIN fa USING (k) LEFT JOIN hi USING (k)), "
    "z1 AS (SELECT *, summed = 'C' AND (held = 0 OR idle) AS emptied FROM z0), "
    "z2 AS (SELECT *, CASE WHEN unaudited THEN 'manual' WHEN patterns IS NULL AND summed = 'manual' AND absent THEN 'C' WHEN patterns IS NULL THEN summed WHEN normative > 0 THEN 'NC' WHEN absent THEN 'C' WHEN nc THEN 'manual' WHEN held = 0 AND own THEN 'manual' WHEN emptied AND seen THEN 'manual' ELSE summed END AS a, "
    "CASE WHEN unaudited THEN FALSE WHEN patterns IS NULL AND summed = 'manual' AND absent THEN TRUE WHEN patterns IS NULL THEN emptied WHEN normative > 0 THEN FALSE WHEN absent THEN TRUE WHEN nc THEN FALSE WHEN held = 0 AND own THEN FALSE WHEN emptied AND seen THEN FALSE ELSE emptied END AS ga FROM z1), "
    "z3 AS (SELECT *, k % 13 = 0 AND EXISTS (SELECT 1 FROM fs WHERE rule_id = 'signup-0' AND NOT advisory) AS foreign_, (judged OR unproven) AND a = 'C' AND NOT ga AS guarded FROM z2), "
    "z4 AS (SELECT *, CASE WHEN foreign_ THEN 'NC' WHEN guarded THEN 'manual' ELSE a END AS b, ga AND NOT foreign_ AS gb FROM z3), "
    "z5 AS (SELECT *, b = 'manual' AND NOT judged AND NOT unaudited AND NOT unproven AND k % 4 = 1 AS rescued FROM z4), "
    "z6 AS (SELECT *, CASE WHEN rescued THEN 'C' ELSE b END AS d, CASE WHEN k % 37 = 0 THEN (k // 37) % 4 END AS r FROM z5)"
)


@query(
    f"{_WITH}, {_RESULTS} SELECT id, theme, CASE r WHEN 0 THEN CASE WHEN d = 'NC' THEN 'NC' ELSE 'manual' END WHEN 1 THEN 'C' WHEN 2 THEN 'C' WHEN 3 THEN 'NC' ELSE d END AS status, "
    "CASE WHEN r = 1 THEN TRUE WHEN r IS NOT NULL THEN FALSE ELSE gb AND NOT rescued END AS inapplicable, normative, candidates, CASE WHEN r IS NOT NULL THEN 'human' WHEN rescued THEN 'scan' END AS decided_by FROM z6"
)
def pack_results(spark, sf_dir):
    """A standards pack derived from an audit: all rungs of the ladder, for as many criteria as there are customers."""
    k = F.col("k")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), text("k", F.col("c_custkey")).alias("id"))
    scs = F.array(*[F.lit(sc) for sc, *_ in _DIM])
    nth = lambda n: F.element_at(scs, (n % _N + 1).cast("int"))
    strings = lambda *s: F.array(*[F.lit(x) for x in s])
    silent = F.when(k % 5 == 0, F.lit(False)).when(k % 5 == 1, F.lit(True))
    pack = keys.select(
        "id", (k % 7).alias("theme"), F.when(k % 29 == 0, strings("9.9.9")).otherwise(F.array(nth(k), nth(k * 3 + 1))).alias("wcag"),
        F.when(k % 4 == 1, strings("click-0", "view-1")).when(k % 4 == 2, strings("error-*")).when(k % 4 == 3, strings("signup-2", "click-1")).alias("patterns"),
        (k % 31 == 0).alias("own_rules"), (k % 6 == 0).alias("judgment"), silent.alias("silent"),
    )
    found = _findings(spark, sf_dir).where("seq % 97 = 0").select("sc", F.concat_ws("-", "rule_id", (F.col("seq") % 3).cast("string")).alias("rule_id"), "advisory")
    effects = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(p).alias("pattern"), F.lit(e).alias("effect")) for i, (p, e) in enumerate([("click-0", "decisive-nc"), ("click-*", "candidate"), ("*", "decisive-nc")])])
    verdict = F.element_at(strings("manual", "NA", "C", "NC"), (F.floor(k / 37) % 4 + 1).cast("int"))
    return packs.results(
        pack, _criteria(spark), found, spark.createDataFrame([("view-1", True), ("click-1", False)], "rule_id string, advisory boolean"), spark.createDataFrame([("9.9.9",)], "sc string"),
        keys.where((k % 5 < 2)).select("id", F.explode(effects).alias("e")).select("id", "e.*"), keys.where(k % 13 == 0).select("id", F.lit("signup-0").alias("rule_id")), keys.where(k % 8 == 3), keys.where(k % 9 == 1),
        spark.createDataFrame([("click-0", True), ("view-1", True), ("signup-2", True), ("click-1", False)], "rule_id string, everywhere boolean"), keys.where(k % 37 == 0).select("id", verdict.alias("status"), F.lit("human").alias("decided_by")),
    )
