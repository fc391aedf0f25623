"""Store comparison by digests against the comparison of everything."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import compare

FIELDS = "procurement_id string, purchaser_name string, estimated_value_eur string, has_lots string, winners_json string"


def store(rng, n):
    names = ["SIA A", 'SIA "A"', "B", "", None, "a", "1", "1:1"]
    lists = [None, "[]", "null", '[{"name": "A", "reg_no": "1"}]', "Acme", "{}"]
    return [(str(i), rng.choice(names), rng.choice(["1", "1.00", "2", None, ""]), rng.choice(["1", "true", "Nē", None]), rng.choice(lists)) for i in range(n)]


def sides(spark, seed=3, n=400):
    rng = random.Random(seed)
    first = store(rng, n)
    second = [r if rng.random() < 0.7 else (r[0], *store(rng, 1)[0][1:]) for r in first if rng.random() < 0.95]
    return spark.createDataFrame(first[:-5] + [(None, *first[0][1:])], FIELDS), spark.createDataFrame(second + [("only", "x", "1", "1", None)], FIELDS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("buckets", [1, 7, compare.BUCKETS])
@pytest.mark.parametrize("field_set", ["all", "business"])
def test_same_differences(spark, buckets, field_set):
    first, second = sides(spark)
    wide, changed = compare.compare_wide(first, second, field_set), compare.compare_changed(first, second, field_set, buckets)
    assert rows(compare.compare_long(changed, field_set)) == rows(compare.compare_long(wide, field_set))
    assert rows(compare.summary_of_changed(changed, first, second, field_set)) == rows(compare.summary(wide, field_set))
    assert rows(compare.differing_ids(changed)) == rows(compare.differing_ids(wide))


def test_only_changed_rows_are_parsed(spark):
    first = spark.range(20_000).select(F.col("id").cast("string").alias("procurement_id"), F.concat(F.lit("B"), F.col("id") % 9).alias("purchaser_name"))
    second = first.withColumn("purchaser_name", F.when(F.pmod(F.xxhash64("procurement_id"), F.lit(100)) == 0, F.lit("other")).otherwise(F.col("purchaser_name")))
    changed = second.where("purchaser_name = 'other'").count()
    assert compare.raw_differences(first, second).count() == changed and 100 < changed < 400
    assert compare.raw_differences(first, first).count() == 0


def test_repeated_rows_do_not_cancel(spark):
    row = ("1", "A", "1", "1", None)
    first, second = spark.createDataFrame([row], FIELDS), spark.createDataFrame([row, ("2", "B", None, None, None), ("2", "B", None, None, None)], FIELDS)
    assert rows(compare.compare_long(compare.compare_changed(first, second, buckets=1))) == rows(compare.compare_long(compare.compare_wide(first, second)))


def test_empty_stores(spark):
    none = spark.createDataFrame([], FIELDS)
    changed = compare.compare_changed(none, none)
    assert rows(changed) == [] and rows(compare.summary_of_changed(changed, none, none)) == rows(compare.summary(compare.compare_wide(none, none)))
