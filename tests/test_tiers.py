"""Tiered compaction: many micro-batches, crashes, repeats."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import types as T

from tenderlake.operators import merge
from tenderlake.streaming import sync, tiers

ROWS = "k long, first string, last string, known string, most double, seq long"
RULES = {"first": merge.FIRST, "last": merge.LAST, "known": merge.LAST_KNOWN, "most": merge.GREATEST}


def made(seed, n, start=0):
    rng = random.Random(seed)
    some = lambda i: rng.choice([None, f"v{i}"])
    return [(rng.choice([None, *range(9)]), some(i), some(i), some(i), rng.choice([None, float(i % 7)]), i) for i in range(start, start + n)]


def table_of(spark, folder, **more):
    schema = T.StructType([f for f in spark.createDataFrame([], ROWS).schema if f.name != "seq"])
    return tiers.Tiered(str(folder / "t"), schema, ("k",), RULES, **{"fan": 3, "buckets": 3, **more})


def put(spark, table, number, rows):
    batch = spark.createDataFrame(rows, ROWS).coalesce(1)
    merge.fold(batch, table.keys, table.rules).coalesce(1).write.mode("overwrite").parquet(f"{table.path}/version={number}")


def found(df):
    return sorted((tuple(r) for r in df.select("k", *RULES).collect()), key=repr)


def whole(spark, rows):
    return found(merge.fold(spark.createDataFrame(rows, ROWS), ("k",), RULES))


def test_fifty_batches_read_few_folders(spark, tmp_path):
    table, rows = table_of(spark, tmp_path, fan=4, buckets=2), []
    for n in range(50):
        part = made(n, 6, 6 * n)
        rows += part
        put(spark, table, n, part)
        tiers.compact(spark, table)
        assert len(tiers.runs(spark, table)) <= (table.fan - 1) * (1 + math.log(n + 1, table.fan))
    assert found(tiers.current(spark, table)) == whole(spark, rows)
    assert [(r.tier, r.first, r.last) for r in tiers.runs(spark, table)] == [(2, 0, 15), (2, 16, 31), (2, 32, 47), (0, 48, 48), (0, 49, 49)]
    for k in (None, 3, 77):
        assert found(tiers.find(spark, table, k=k)) == [r for r in whole(spark, rows) if r[0] == k]


def test_crash_between_write_and_switch(spark, tmp_path, monkeypatch):
    table, rows = table_of(spark, tmp_path), []
    for n in range(3):
        rows += made(n, 8, 8 * n)
        put(spark, table, n, made(n, 8, 8 * n))

    def crash(*_):
        raise RuntimeError("gone")

    with monkeypatch.context() as broken:
        broken.setattr(tiers, "_switch", crash)
        with pytest.raises(RuntimeError):
            tiers.compact(spark, table)
    assert found(tiers.current(spark, table)) == whole(spark, rows) and [r.tier for r in tiers.runs(spark, table)] == [0, 0, 0]
    orphan = tiers.superseded(spark, table)
    assert len(orphan) == 1
    assert tiers.compact(spark, table) == 1 and [r.tier for r in tiers.runs(spark, table)] == [1]
    assert set(tiers.superseded(spark, table)) == {*orphan, *(f"{table.path}/version={n}" for n in range(3))}
    put(spark, table, 2, made(2, 8, 16))  # a repeated batch
    assert found(tiers.current(spark, table)) == whole(spark, rows)


def test_unfinished_batch_is_left_alone(spark, tmp_path):
    table = table_of(spark, tmp_path)
    for n in range(3):
        put(spark, table, n, made(n, 4, 4 * n))
    (tmp_path / "t" / "version=2" / "_SUCCESS").unlink()
    assert tiers.compact(spark, table) == 0 and len(tiers.runs(spark, table)) == 2
    assert tiers.compact(spark, table, before=1) == 0


def test_empty_table(spark, tmp_path):
    table = table_of(spark, tmp_path)
    assert tiers.compact(spark, table) == 0 and tiers.current(spark, table).count() == 0 and tiers.superseded(spark, table) == []


def test_stream_equals_batch(spark, tmp_path):
    table, rows = table_of(spark, tmp_path), made(5, 56)
    for i in range(7):
        spark.createDataFrame(rows[8 * i : 8 * i + 8], ROWS).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{i}"))
    source = sync.landed_stream(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], ROWS).schema, files_per_batch=1)
    tiers.sync_tiered(source, table, str(tmp_path / "log")).awaitTermination()
    assert found(tiers.current(spark, table)) == whole(spark, rows)
    assert [r.tier for r in tiers.runs(spark, table)] == [1, 1, 0]
