"""A mergeable audit state: pages come again in newer versions, and the last version of each is what counts.

The state is a log of batches in one folder. A batch writes which pages it read in which version (``pages``), what was
found on them (``findings``) and by how much every tally changed (``changes``: what the new versions have less what the versions
they replace had). Reading joins findings with the last version of their page; tallies are the sum of all changes, so a small batch costs its
own pages, not the corpus.

Versions: the greatest wins, then the later batch; an older version that arrives late is written down and changes nothing. A page that
comes without version has its batch's number. Within a batch the greatest version of a page counts, then the greatest digest of its
text, so replays agree.

Recovery: a batch overwrites its own folders, and is computed from earlier batches alone, so a batch that is run again leaves the same state.

Scale: findings and pages are partitioned by a hash of the page (``shards``), so a batch that touches few pages reads few
partitions of older findings. A page's rows never meet in a window; replaced findings are found by equi joins.

Edge cases: pages without findings replace older versions that had some; a removed page (``removed``) keeps no finding; null ids are one page;
an empty batch changes nothing; an empty state has no findings and no tallies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.rules import FINDING
from lintel.plans.storage import materialize

TALLY = ("rule_id", "sc", "severity", "advisory")
_PAGES = "page_id long, version long, removed boolean, shard int, batch long"
_FINDINGS = f"{FINDING}, version long, shard int, batch long"
_CHANGES = "rule_id string, sc string, severity string, advisory boolean, delta long, batch long"


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def latest_pages(pages: DataFrame, number: int) -> DataFrame:
    """One row per page of a batch: page_id, version, removed, html. ``pages`` may lack version and removed."""
    version = F.coalesce(F.col("version").cast("long"), F.lit(number)) if "version" in pages.columns else F.lit(number).cast("long")
    removed = F.coalesce("removed", F.lit(False)) if "removed" in pages.columns else F.lit(False)
    rows = pages.select("page_id", version.alias("version"), removed.alias("removed"), "html")
    order = F.struct("version", "removed", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    best = rows.groupBy("page_id").agg(F.max(order).alias("best"))
    # Rows that agree in all of it are one.
    again = rows.withColumn("order", order).join(best, F.col("order").eqNullSafe(F.col("best")) & rows["page_id"].eqNullSafe(best["page_id"]), "left_semi")
    return again.drop("order").dropDuplicates(["page_id"])


@dataclass(frozen=True)
class AuditState:
    """The log in ``folder``, which all executors share."""

    spark: SparkSession
    folder: str
    shards: int = 64

    def _path(self, name: str) -> str:
        """Findings stand in the folder itself, so that it reads as their log; the rest below ``_state``, which readers skip."""
        return self.folder if name == "findings" else f"{self.folder}/_state/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self._path(name)
        return self.spark.read.schema(schema).parquet(path) if _there(self.spark, path) else self.spark.createDataFrame([], schema)

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("page_id"), F.lit(self.shards)).cast("int")

    @staticmethod
    def _some(rows: DataFrame, before: int | None, shards: list[int] | None) -> DataFrame:
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows if shards is None else rows.where(F.col("shard").isin(shards) if shards else F.lit(False))

    def versions(self, before: int | None = None, shards: list[int] | None = None) -> DataFrame:
        """(page_id, shard, version, batch, removed): the version of each page that counts, of batches below ``before`` and of some shards."""
        rows = self._some(self._read("pages", _PAGES), before, shards)
        last = F.max(F.struct("version", "batch", "removed")).alias("last")
        return rows.groupBy("page_id", "shard").agg(last).select("page_id", "shard", "last.*")

    def findings(self, before: int | None = None, shards: list[int] | None = None) -> DataFrame:
        """The findings of the pages as they are now, or as they were ``before`` a batch."""
        rows = self._some(self._read("findings", _FINDINGS), before, shards).alias("f")
        last = self.versions(before, shards).where("not removed").alias("v")
        same = F.col("f.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("f.shard") == F.col("v.shard")) & (F.col("f.version") == F.col("v.version")) & (F.col("f.batch") == F.col("v.batch"))
        return rows.join(last, same, "left_semi").drop("shard", "batch")

    def tallies(self) -> DataFrame:
        """(rule_id, sc, severity, advisory, n) now, from changes alone."""
        sums = self._read("changes", _CHANGES).groupBy(*TALLY).agg(F.sum("delta").alias("n"))
        return sums.where("n <> 0")

    def record(self, number: int, pages: DataFrame, findings: DataFrame) -> None:
        """Write batch ``number``: ``pages`` (page_id, version, removed), one row per page, and the findings on them."""
        read = materialize(pages.select("page_id", "version", "removed", self._shard().alias("shard")), "batch-pages")
        found = findings.withColumn("shard", self._shard()).alias("f").join(read.where("not removed").select("page_id", "shard", "version").alias("p"), F.col("f.page_id").eqNullSafe(F.col("p.page_id")) & (F.col("f.shard") == F.col("p.shard")))
        found = found.select("f.*", F.col("p.version").alias("version"))
        self._write("findings", number, found)
        self._write("pages", number, read)
        # What changes: pages whose version is not below the one that counts so far.
        touched = [r["shard"] for r in read.select("shard").distinct().collect()]  # at most ``shards`` numbers
        before = self.versions(number, touched).alias("b")
        wins = read.alias("r").join(before, F.col("r.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("r.shard") == F.col("b.shard")), "left")
        wins = materialize(wins.where(F.col("b.version").isNull() | (F.col("r.version") >= F.col("b.version"))).select("r.page_id", "r.shard"), "winning-pages")
        of_wins = lambda rows: rows.drop("shard").withColumn("shard", self._shard()).alias("x").join(wins.alias("w"), F.col("x.page_id").eqNullSafe(F.col("w.page_id")) & (F.col("x.shard") == F.col("w.shard")), "left_semi")
        own = self._read("findings", _FINDINGS).where(F.col("batch") == number)
        held = self.findings(number, touched)
        delta = of_wins(own).select(*TALLY, F.lit(1).alias("d")).unionByName(of_wins(held).select(*TALLY, F.lit(-1).alias("d")))
        self._write("changes", number, delta.groupBy(*TALLY).agg(F.sum("d").cast("long").alias("delta")).where("delta <> 0"), by=())

    def _write(self, name: str, number: int, rows: DataFrame, by: tuple[str, ...] = ("shard",)) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self._path(name)}/batch={number}")

    def compacted(self, folder: str) -> AuditState:
        """The same state as one batch in another folder: what was replaced is left behind, the batch's number is the last one."""
        new = AuditState(self.spark, folder, self.shards)
        last = self._read("pages", _PAGES).agg(F.max("batch")).first()[0]
        if last is not None:
            new.record(last, self.versions().select("page_id", "version", "removed"), self.findings().drop("version"))
        return new
