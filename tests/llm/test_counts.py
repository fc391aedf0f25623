import hashlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tenderlake.llm import counts, queries

from .helpers import SF, SF_MORE, documents, empty_reports, odd_reports


@pytest.fixture(scope="module")
def model_path():
    return queries.tokenizer_path(queries.PIECE_BPE)


@pytest.fixture(scope="module")
def library(model_path):
    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return lambda text: (len((text or "").encode()), len(processor.encode(text or "")))


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


def expected(rows, library, limit=counts.LIMIT):
    return sorted(((key, *(both := library(text)), both[1] > limit) for key, text in rows), key=repr)


@pytest.mark.parametrize("root", [SF, SF_MORE])
def test_documents_against_the_library(spark, library, root):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, root)]
    found = queries.op11_digest_counts(spark, root)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert shown(found) == expected(rows, library)


def test_odd_rows_and_empty_tables(spark, library, model_path, tmp_path):
    frame = odd_reports(spark)
    rows = [(r["procurement_id"], r["report_text"]) for r in frame.collect()] + [(99, "<s> </s> <unk> <0x41>")]
    frame = frame.select("procurement_id", "report_text").unionByName(spark.createDataFrame([rows[-1]], "procurement_id long, report_text string"))
    path = str(tmp_path / "cache")
    assert shown(counts.count_tokens(frame, model_path, path, 8)) == expected(rows, library, 8)
    stored = shown(spark.read.parquet(path))
    assert counts.count_tokens(empty_reports(spark), model_path, path).count() == 0
    assert shown(spark.read.parquet(path)) == stored
    assert counts.count_tokens(empty_reports(spark), model_path, str(tmp_path / "none")).count() == 0
    clash = odd_reports(spark).withColumnsRenamed({"content": "n_tokens", "key": "tokenizer"}).withColumn("n_bytes", F.lit("clash"))
    assert shown(counts.count_tokens(clash, model_path, path, 8)) == expected(rows[:-1], library, 8)


@pytest.mark.parametrize("few", [0, counts.FEW_CONTENTS])
def test_only_distinct_misses_are_encoded_and_appended(spark, library, model_path, tmp_path, monkeypatch, few):
    monkeypatch.setattr(counts, "FEW_CONTENTS", few)
    path = str(tmp_path / "cache")
    reports = lambda rows: spark.createDataFrame(rows, "procurement_id string, report_text string")
    first = [("a", "one notice"), ("b", "one notice"), ("c", "another notice"), ("d", None), ("e", "")]
    assert shown(counts.count_tokens(reports(first), model_path, path)) == expected(first, library)
    assert spark.read.parquet(path).count() == 2
    # a stored count answers, so nothing is encoded a second time
    version = counts.tokenizer_version(open(model_path, "rb").read())
    marked = [(hashlib.sha256(b"known text").digest(), 77, version), (hashlib.sha256(b"one notice").digest(), 88, "0" * 64)]
    spark.createDataFrame(marked, "content binary, n_tokens long, tokenizer string").write.mode("append").partitionBy("tokenizer").parquet(path)
    second = [("f", "known text"), ("g", "one notice"), ("h", "a third notice"), ("h", "a third notice")]
    found = shown(counts.count_tokens(reports(second), model_path, path))
    assert found == [("f", 10, 77, False), *expected(second[1:], library)]
    own = spark.read.parquet(path).where(F.col("tokenizer") == version)
    assert own.count() == 4 and own.select("content").distinct().count() == 4
    assert shown(counts.count_tokens(reports(second), model_path, path)) == found
    assert spark.read.parquet(path).count() == 5


def test_contents_stored_twice_count_once(spark, model_path, tmp_path):
    path = str(tmp_path / "cache")
    version = counts.tokenizer_version(open(model_path, "rb").read())
    twice = [(hashlib.sha256(b"text").digest(), 5, version)] * 2
    spark.createDataFrame(twice, "content binary, n_tokens long, tokenizer string").write.partitionBy("tokenizer").parquet(path)
    rows = spark.createDataFrame([(1, "text")], "procurement_id long, report_text string")
    assert shown(counts.count_tokens(rows, model_path, path)) == [(1, 4, 5, False)]
