"""Training-data pipeline over documents: quality rules, toxicity, near-duplicates, packing.

Each stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import packing, quality, queries, simhash, toxicity
from tenderlake.llm.common import as_reports
from tenderlake.session import shared_folder


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """``names`` made longer until no column of ``docs`` has them."""
    out = []
    for name in names:
        while name in docs.columns:
            name += "_"
        out.append(name)
    return out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines they remove; ``n_chars`` follows the text."""
    judged = quality.judge(as_reports(docs, purchaser_name="source")).where("kept")
    key, content, gone = _unused(docs, "kept_id", "kept_content", "removed_lines")
    verdicts = judged.select(F.col("procurement_id").alias(key), F.col("content").alias(content), F.col("removed").alias(gone)).dropDuplicates([key, content])
    joined = docs.join(verdicts, docs["doc_id"].eqNullSafe(F.col(key)) & (quality.content_key(docs["text"]) == F.col(content)))
    text = quality.without_lines(docs["text"], F.col(gone))
    changed = F.size(gone) > 0
    new = {"text": text, "n_chars": F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])}
    return joined.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones among them, does not call toxic."""
    chain = queries.chain_of(spark, docs, sf_dir)
    return docs.where(toxicity.probabilities(F.col("text"), chain)[len(chain.categories) - 1] < 0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    groups = simhash.similar_groups(as_reports(docs))
    key, content = _unused(docs, "kept_id", "kept_content")
    kept = groups.where("leads").select(F.col("first_id").alias(key), F.col("content").alias(content))
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(kept, docs["doc_id"].eqNullSafe(F.col(key)) & (own == F.col(content)))
    return joined.dropDuplicates([key, content]).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in their sequences."""
    pieces = packing.token_pieces(as_reports(docs), queries.tokenizer_path(queries.WORD_BPE), 1)
    return packing.pack(pieces).withColumnRenamed("procurement_id", "doc_id")


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

# Tokenizing and training can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what lies between them is kept in the session's shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
