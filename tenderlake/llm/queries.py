"""Queries of the training-data operators over the given tables, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, counts, dropout, language, licences, orderhash, packing, quality, simhash, tokenids, toxicity, urls, whitening
from ..session import shared_folder
from .common import as_reports, table

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
CATEGORIES = ("quality", "toxic")

# Fixed values of the URL query: the rules of its contract, and sites listed as unwanted.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
LISTED = (
    "http://ads-track.example.com/",
    "http://adult-x.example.com/",
    "http://casino-win.example.net/",
    "http://cheap-pills.example.net/",
    "http://free-bets.example.net/",
    "http://spam-farm.example.org/",
)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("procurement_id", "doc_id")


def op1_language_id(spark: SparkSession, root: str) -> DataFrame:
    reports = as_reports(table(spark, root, "documents"), language="lang")
    fold = F.crc32(F.coalesce(F.col("procurement_id").cast("string"), F.lit(""))) % 5
    model = language.train_languages(reports.where(fold != 0))
    found = language.predict_languages(reports, model)
    return _named(found).select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"), F.col("language").alias("lang_pred"), "score")


def op2_toxicity_chain(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    return _named(toxicity.score_toxicity(as_reports(documents), chain_of(spark, documents, root)))


def chain_of(spark: SparkSession, documents: DataFrame, root: str) -> toxicity.ChainModel:
    """Chain trained on the given labels of ``documents``; of several labels of one document each category's largest counts."""
    labels = table(spark, root, "labels").select("doc_id", *CATEGORIES).dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in CATEGORIES))
    return toxicity.train_chain(as_reports(documents.join(labels.select("doc_id", *(F.col(c).alias(f"_{c}") for c in CATEGORIES)), "doc_id"), **{c: f"_{c}" for c in CATEGORIES}), CATEGORIES)


def op3_licence_scan(spark: SparkSession, root: str) -> DataFrame:
    return _named(licences.scan_licences(as_reports(table(spark, root, "documents"))))


def op4_order_minhash(spark: SparkSession, root: str) -> DataFrame:
    return _named(orderhash.fingerprint_edits(as_reports(table(spark, root, "documents"))))


def op5_simhash_pivots(spark: SparkSession, root: str) -> DataFrame:
    return _named(simhash.group_by_fingerprint(as_reports(table(spark, root, "documents"))))


def op6_url_filter(spark: SparkSession, root: str) -> DataFrame:
    """Every page against the rules and a list: the sites of ``LISTED`` and the URLs of all pages whose id is divisible by 100."""
    records = table(spark, root, "pages").select(F.col("page_id").alias("procurement_id"), F.col("url").alias("procurement_url"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(u,) for u in LISTED], "procurement_url string").union(records.where("procurement_id % 100 = 0").select("procurement_url"))
    return urls.screen_urls(records, rules, listed).withColumnRenamed("procurement_id", "page_id")


def op7_token_files(spark: SparkSession, root: str) -> DataFrame:
    path = f"{tokenids.token_file_folder(spark)}/{uuid.uuid4().hex}"
    tokenids.write_token_file(as_reports(table(spark, root, "documents")), tokenizer_path(WORD_BPE), 2, path)
    return _named(tokenids.read_token_file(spark, path))


def op8_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return _named(packing.pack(packing.token_pieces(as_reports(table(spark, root, "documents")), tokenizer_path(WORD_BPE), 1)))


def op9_line_quality(spark: SparkSession, root: str) -> DataFrame:
    judged = quality.judge(as_reports(table(spark, root, "documents"), purchaser_name="source"))
    return _named(judged).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def op10_merge_dropout(spark: SparkSession, root: str) -> DataFrame:
    return _named(dropout.encode_reports(as_reports(table(spark, root, "documents")), tokenizer_path(PIECE_BPE), keep_ids=False))


def op11_digest_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts through a cache that is empty at first, so each call encodes every distinct text once."""
    cache = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    return _named(counts.count_tokens(as_reports(table(spark, root, "documents")), tokenizer_path(PIECE_BPE), cache))


def _profiles(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("bidder"), F.col("embedding").alias("profile"))


def op12_ns_centroids(spark: SparkSession, root: str) -> DataFrame:
    return centroids.cluster_bidders(_profiles(spark, root), entries=64).withColumnRenamed("bidder", "vec_id")


def op13_block_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whiten_bidders(_profiles(spark, root)).withColumnRenamed("bidder", "vec_id")


def pipeline(spark: SparkSession, root: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, root)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_toxicity_chain, op3_licence_scan, op4_order_minhash, op5_simhash_pivots, op6_url_filter, op7_token_files,
        op8_best_fit_packing, op9_line_quality, op10_merge_dropout, op11_digest_counts, op12_ns_centroids, op13_block_whitening, pipeline,
    )
}

_HOST = r"""translate(regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_PATH = r"regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1)"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_LISTED = ", ".join(f"('{u.split('//')[1].rstrip('/')}', '')" for u in LISTED)

ORACLES: dict[str, str] = {
    "op6_url_filter": f"""WITH rules(rh, rp, rv) AS (VALUES {_RULES}), split AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
        listed(lh, lp) AS (VALUES {_LISTED} UNION SELECT regexp_replace(host, '^www\\.', ''), rtrim(path, '/') FROM split WHERE page_id % 100 = 0 AND host <> ''),
        urls AS (SELECT DISTINCT host, path FROM split),
        best AS (SELECT host, path, arg_max(rh || rp, (length(rh || rp), length(rh))) AS rule, arg_max(rv, (length(rh || rp), length(rh))) AS rv
            FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
        bad AS (SELECT DISTINCT host, path FROM urls JOIN listed ON (host = lh OR ends_with(host, '.' || lh)) AND (rtrim(path, '/') = lp OR starts_with(path, lp || '/')))
        SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.rv, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM split s LEFT JOIN best b USING (host, path) LEFT JOIN bad USING (host, path)""",
}
