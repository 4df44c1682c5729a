"""A corpus pipeline: classifier, line dedup, near-dedup, mixing, packing, each over all its predecessor kept.

Every stage but the last returns the columns of ``documents``, extra ones included; each is written as Parquet and read again.

Edge cases, stage by stage:

* quality classifier: a null or empty text, or one of white space, is rejected; equal texts are kept or rejected together; texts of any length are scored whole.
* line dedup: a null text stays null; rows that repeat an id keep a line whose largest id they carry; null ids lose a shared line; n_chars follows the text.
* near-dedup: of texts that link, the row of the smallest id stays, of rows that agree in all of it one; texts without words link with nothing and stay.
* mixing: repeated rows are drawn each by itself; null sources are a source; a row comes at most twice.
* packing: a null or empty text is the end id alone; texts longer than a sequence are cut; ties go by row key, checksum and start.

An empty table gives an empty result. Columns of any other name travel packed, so that none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintel.llm.line_dedup import dedup_lines
from lintel.llm.minhash import keep_one
from lintel.llm.mixing import mix
from lintel.llm.packing import pack
from lintel.llm.quality import keep_good
from lintel.plans.storage import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
