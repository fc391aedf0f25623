"""Fixture rows that every training-data operator has to bear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"
LONG = "very long text of many words " * 8000

ODD_ROWS = [
    (1, "One short notice about a tender.", "en", "Buyer A"),
    (2, None, "en", "Buyer A"),
    (3, "", None, None),
    (4, "   \n\t\n ", "lv", "Buyer A"),
    (5, LONG, "en", "Buyer B"),
    (6, "same text for all of us", "en", "Buyer B"),
    (7, "same text for all of us", None, "Buyer B"),
    (7, "same text for all of us", None, "Buyer B"),
    (None, "a report without an id", "en", None),
    (None, None, None, None),
    (8, "x" * 200_000, "en", "Buyer C"),
    (9, "12345 6789 !!! ... ###", "en", "Buyer C"),
    (10, "Ünïcödé İstanbul Σίσυφος 采购公告 \U0001f3d7 ▁ é", "el", "Buyer C"),
]
# Names that operators use inside; they must not get in the way.
CLASH = ("text", "content", "score", "key", "at", "kind", "group", "row", "host", "n_words", "fingerprint", "verdict", "start", "length", "toxic")


def odd_reports(spark: SparkSession, rows=ODD_ROWS) -> DataFrame:
    df = spark.createDataFrame(rows, "procurement_id long, report_text string, language string, purchaser_name string")
    for name in CLASH:
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def empty_reports(spark: SparkSession) -> DataFrame:
    return odd_reports(spark, [])


def documents(spark: SparkSession, root: str = SF) -> list:
    return spark.read.parquet(f"{root}/documents.parquet").orderBy("doc_id").collect()
