"""Token counts of whole report texts through a digest cache.

The cache is a Parquet table of ``tokenizer, content, n_tokens``, one folder per
tokenizer version: the SHA-256 of the model file and that of the normalised
content (UTF-8; a null text is empty, and nothing else is changed, since a
count may depend on every character). Reports meet the cache by digest, only
distinct contents it lacks are encoded, and their counts are appended. A report
text that many procurements carry, or that was counted in an earlier run, costs a
digest.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT = 4096
CACHE_FIELDS = "content binary, n_tokens long, tokenizer string"
# Characters encoded by one call of the tokenizer.
LOT_CHARS = 100_000
# Missing contents (32 bytes each) up to which they are sent to all tasks.
FEW_CONTENTS = 100_000


def tokenizer_version(model: bytes) -> str:
    """Digest that stands for a tokenizer in the cache; another model file never meets its counts."""
    return hashlib.sha256(model).hexdigest()


def cached_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """``content, n_tokens`` stored for a tokenizer version, each content once; none if there is no cache yet.

    Two runs that append at the same time may both store a content; they store
    the same count.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_FIELDS).select("content", "n_tokens")
    stored = spark.read.schema(CACHE_FIELDS).parquet(cache_path).where(F.col("tokenizer") == version)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _counts(texts: DataFrame, model: bytes) -> DataFrame:
    """``content, n_tokens`` of ``content, report_text`` rows, by the library itself."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    version = tokenizer_version(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        kept = worker_cache("count_models")
        if version not in kept:
            kept.clear()
            kept[version] = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            lot, held, sizes = [], 0, []
            for value in batch.column(1):
                # one thread and short lots: a task has one core, and every thread keeps its own memory
                text = value.as_py()
                lot.append(text)
                held += len(text)
                if held >= LOT_CHARS:
                    sizes += map(len, kept[version].encode_as_numpy(lot, num_threads=1))
                    lot, held = [], 0
            if lot:
                sizes += map(len, kept[version].encode_as_numpy(lot, num_threads=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "report_text").mapInArrow(count, "content binary, n_tokens long")


def count_tokens(reports: DataFrame, model_path: str, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """``procurement_id, n_bytes, n_tokens, over_limit`` of every whole report, one row per input row.

    ``reports``: ``procurement_id`` of any type and ``report_text``; other columns
    don't matter. ``model_path`` names a SentencePiece model, ``cache_path`` a folder
    that all executors reach; it is made if absent. ``n_tokens`` is what the library
    gives for the whole text without begin and end ids, ``n_bytes`` its UTF-8 length,
    ``over_limit`` whether there are more than ``limit`` tokens. A null or empty text
    has 0 of both and is not encoded. Repeated rows repeat in the result. An empty
    table gives no rows and leaves the cache as it is.
    """
    spark = reports.sparkSession
    with open(model_path, "rb") as file:
        model = file.read()
    version = tokenizer_version(model)
    text = F.coalesce(F.col("report_text"), F.lit(""))
    content = F.unhex(F.sha2(text, 256))
    digests = written(reports.select("procurement_id", F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content")))
    # a content's copies shrink to one row per task before they are dealt out
    wanted = digests.where(F.col("n_bytes") > 0).select("content").distinct()
    missing = written(wanted.join(cached_counts(spark, cache_path, version), "content", "left_anti"))
    texts = reports.where(F.col("report_text") != "").select(content.alias("content"), "report_text")
    n_missing = missing.count()
    if n_missing <= FEW_CONTENTS:
        # a warm cache: known texts leave before anything is dealt out
        texts = texts.join(F.broadcast(missing), "content", "left_semi")
    once = texts.groupBy("content").agg(F.any_value("report_text").alias("report_text"))
    if n_missing:
        fresh = once.join(missing, "content", "left_semi")
        _counts(fresh, model).withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    known = cached_counts(spark, cache_path, version)
    met = digests.join(known, "content", "left")
    n_tokens = F.when(F.col("n_bytes") > 0, F.col("n_tokens")).otherwise(F.lit(0).cast("long"))
    return met.select("procurement_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
