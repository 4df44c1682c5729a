"""Token counts through a digest cache: no text is ever encoded twice by the same tokenizer.

A text is known by the SHA-256 of its normalised content, a tokenizer by the digest of its file and the
version of its library. Documents join the stored counts by both; only the distinct texts without a stored count are encoded,
and their counts are appended to the cache, a Parquet table partitioned by tokenizer. The result is the documents
joined with the cache.

Normalising is what surely leaves a tokenizer's ids as they are: a missing text is the empty one, nothing else.

Scale: texts move only for misses. A few misses (at most ``small_misses`` digests, 32 bytes each) are broadcast, so that a warm run
shuffles no other text; more of them meet the texts in the shuffle that makes texts distinct, after copies have collapsed on the map side.
A digest that very many rows share is looked up by a bounded broadcast (:func:`lintel.operators.skew.lookup`).
Long texts are counted in windows cut where this tokenizer surely cuts too, in batches bounded by bytes.

Recovery: keys and misses are written tables; the cache is appended by Spark's committer, whole or not at all. Two
runs that append the same digest leave the same count twice, and reading takes one. A failed run leaves nothing, or counts that the next one finds.

Edge cases: a null or empty text has 0 bytes and 0 tokens; strings of special tokens inside a text are what the library makes of them by default (one
id); repeated rows and ids are rows each; null ids stay; a text of any length is counted whole; an empty table gives
an empty result and appends nothing; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.skew import lookup
from lintel.plans.storage import application_folder, materialize, small_batches

_WINDOW = 1 << 20
#: Characters that are encoded at a time: the library holds about thirty times as much meanwhile.
_BATCH = 1 << 18
CACHE = "content binary, n_tokens long, tokenizer string"
_loaded: dict = {}


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def tokenizer_version(path: str) -> str:
    """Library, its version and the digest of the tokenizer's file: counts of one version never serve another."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        return f"{library.__name__}-{library.__version__}-{hashlib.file_digest(file, 'sha256').hexdigest()}"


def windows(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters, each but the first beginning with a space between two letters or digits."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while 0 < end < len(text) - 1 and not (text[end - 1].isalnum() and text[end + 1].isalnum()):
            end = text.find(" ", end + 1)
        if not 0 < end < len(text) - 1:
            break
        yield text[at:end]
        at = end
    yield text[at:]


class Counter:
    """Counts ids as the tokenizer's library gives them, without added tokens, truncation or padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.many = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer, pre_tokenizers

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            # A byte-level model without normaliser cuts before a space that stands between letters, whatever comes before or after.
            self.cuts = model.normalizer is None and isinstance(model.pre_tokenizer, pre_tokenizers.ByteLevel) and not model.pre_tokenizer.add_prefix_space
            self.cuts = self.cuts and not any(t.lstrip or t.rstrip or " " in t.content for t in model.get_added_tokens_decoder().values())
            self.many = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str], window: int = _WINDOW) -> list[int]:
        out, held, owners, size = [0] * len(texts), [], [], 0
        for i, text in enumerate(texts):
            for part in windows(text, window) if self.cuts else (text,):
                held.append(part)
                owners.append(i)
                size += len(part)
                if size >= _BATCH or len(held) >= 1000:
                    for owner, n in zip(owners, self.many(held), strict=True):
                        out[owner] += n
                    held, owners, size = [], [], 0
        for owner, n in zip(owners, self.many(held) if held else [], strict=True):
            out[owner] += n
        return out


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(count(batch.column("text").to_pylist()), pa.int64())], ["content", "n_tokens"])

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer; an absent cache is an empty one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "content binary, n_tokens long")
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, wanted: DataFrame, path: str, cache: str, version: str, small_misses: int = 500_000) -> int:
    """Encode the distinct texts of ``docs`` whose digest is in ``wanted`` and not in the cache, append them, and say how many they were."""
    spark = docs.sparkSession
    misses = materialize(wanted.join(stored_counts(spark, cache, version), "content", "left_anti").select("content"), "misses")
    n = misses.count()
    if not n:
        return 0
    texts = docs.select(content_digest(F.col("text")).alias("content"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # On a cold cache everything is missing and nothing has to be told apart.
    some = n < wanted.count()
    if some and n <= small_misses:
        texts = texts.join(F.broadcast(misses), "content", "left_semi")
    texts = texts.groupBy("content").agg(F.first("text").alias("text"))
    if some and n > small_misses:
        texts = texts.join(misses, "content", "left_semi")
    counted = texts.mapInArrow(_encode(path), "content binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return n


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, cache: str | None = None, small_misses: int = 500_000) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``cache`` is a folder that outlives the run; without one the run has an empty cache of its own below the shared folder.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    small_batches(spark)
    version = tokenizer_version(path)
    cache = cache or f"{application_folder(spark)}/{uuid.uuid4().hex}-token-cache"
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keyed = materialize(docs.select("doc_id", size.alias("n_bytes"), content_digest(F.col("text")).alias("content")), "keyed")
    wanted = materialize(keyed.groupBy("content").agg(F.count(F.lit(1)).alias("n")), "wanted")
    fill_cache(docs, wanted.select("content"), path, cache, version, small_misses)
    found = lookup(keyed, stored_counts(spark, cache, version), "content", counts=wanted)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
