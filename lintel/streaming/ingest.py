"""Extension: page snapshots as a stream. Each micro-batch is parsed and audited by the batch rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintel.operators.rules import findings
from lintel.operators.state import AuditState, latest_pages
from lintel.plans.storage import materialize
from lintel.sources.html import elements

PAGES = "page_id long, url string, html string, version long, removed boolean"


def record_pages(state: AuditState, number: int, pages: DataFrame, only: list[str] | None = None) -> None:
    """Audit one batch of pages (page_id, html, and version and removed where they are known) into the state."""
    read = materialize(latest_pages(pages, number), "batch")
    state.record(number, read, findings(elements(read.where(~F.col("removed"))), only))


def audit_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, only: list[str] | None = None) -> StreamingQuery:
    """Watch a folder of parquet pages and keep the audit of their last versions in ``sink``, an :class:`AuditState`.

    ``sink`` read as parquet is the log of findings; ``AuditState(spark, sink).findings()`` are those of the pages as they are
    now. A batch that is replayed overwrites itself, so a restart adds nothing twice.
    """
    pages = spark.readStream.schema(PAGES).parquet(source)

    def batch(rows: DataFrame, number: int) -> None:
        record_pages(AuditState(rows.sparkSession, sink), number, rows, only)

    return pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
