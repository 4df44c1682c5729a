"""Where intermediate results go so that lost executors cost no more than a re-read.

Lineage is cut by writing a table in the folder that the cluster names in
``spark.checkpoint.dir``. Only on one machine, and only where that setting is missing (tests), a
folder of this process is made up. Tables stand in one folder per application;
:func:`drop_intermediates` removes it when no result that reads from it is wanted any more, and the
end of the process tries to.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_used: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from the session's settings."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lintel-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def application_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/lintel-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: full lineage cut."""
    spark = df.sparkSession
    folder = application_folder(spark)
    if folder not in _used:
        _used.add(folder)
        atexit.register(_drop_quietly, spark)
    path = f"{folder}/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete every table that this application wrote by :func:`materialize`."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _drop_quietly(spark: SparkSession) -> None:
    try:
        drop_intermediates(spark)
    except Exception:  # the session may have ended before the process
        pass


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialize` that no later step reads."""
    if df is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getParent().getName().startswith("lintel-"):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of Arrow batches: texts of any length travel in them, on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
