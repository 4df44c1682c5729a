"""Named queries of the audit state: the given pages audited in batches that replace, remove and repeat pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.state import AuditState
from lintel.plans.registry import query
from lintel.plans.storage import application_folder, table
from lintel.streaming.ingest import record_pages

_ONLY = ["missing-main-landmark", "img-alt-missing"]
#: Which version of a page is the last: the third batch removes every seventh page and restores every fifth, the second rebuilt every third.
_LAST = (
    "WITH p AS (SELECT page_id AS i, html LIKE '%<main%' OR html LIKE '%role=\"main\"%' AS has_main FROM pages), "
    "f AS (SELECT i AS page_id, 'missing-main-landmark' AS rule_id, CAST(1 AS BIGINT) AS n FROM p WHERE NOT has_main AND i % 7 <> 0 AND (i % 5 = 0 OR i % 3 <> 0) "
    "UNION ALL SELECT i, 'img-alt-missing', 1 + i % 4 FROM p WHERE i % 7 <> 0 AND i % 5 <> 0 AND i % 3 = 0) "
)


def _state(spark: SparkSession, sf_dir: str) -> AuditState:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    i = F.col("page_id")
    state = AuditState(spark, f"{application_folder(spark)}/{uuid.uuid4().hex}-state", shards=4)
    images = F.expr("repeat('<img src=x>', CAST(1 + page_id % 4 AS INT))")
    rebuilt = F.replace(F.replace(F.replace("html", F.lit("<article>"), F.lit("<main>")), F.lit("</article>"), F.lit("</main>")), F.lit("<body>"), F.concat(F.lit("<body>"), images))
    version = lambda n: F.lit(n).alias("version")
    record_pages(state, 0, pages.select("page_id", "html", version(10)), _ONLY)
    # A batch may bring a page twice.
    both = pages.where(i % 3 == 0).select("page_id", rebuilt.alias("html"), version(20))
    record_pages(state, 1, both.unionByName(both.select("page_id", F.lit("<html><body>draft</body></html>").alias("html"), version(19))), _ONLY)
    again = pages.where((i % 5 == 0) | (i % 7 == 0)).select("page_id", "html", version(30), (i % 7 == 0).alias("removed"))
    record_pages(state, 2, again, _ONLY)
    # A version from long ago comes last.
    record_pages(state, 3, pages.where(i % 11 == 0).select("page_id", F.lit("<html><body><img src=old></body></html>").alias("html"), version(5)), _ONLY)
    return state


@query(_LAST + "SELECT page_id, rule_id, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1, 2")
def audit_upserts(spark, sf_dir):
    """Findings of the last version of every page after four batches."""
    return _state(spark, sf_dir).findings().groupBy("page_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(_LAST + "SELECT rule_id, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1")
def audit_upsert_tallies(spark, sf_dir) -> DataFrame:
    """The tallies that the batches' changes add up to."""
    return _state(spark, sf_dir).tallies().select("rule_id", "n")
