"""Tiered compaction of the version folders that the incremental runs write.

A manifest names runs: folded tables that each stand for a row of consecutive
micro-batches. ``fan`` runs of one tier are folded into one run of the next tier,
so a read folds at most about ``fan`` runs per tier, whose number grows with the
logarithm of the batches. A run is written in full before a new manifest names
it; a crash in between leaves a folder that nobody reads. Runs are written by
buckets of their keys, and a lookup of one key reads one bucket of each.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from .sync import VERSION

BUCKET = "key_bucket"


@dataclass(frozen=True)
class Tiered:
    """A merged table: version folders under ``path``, runs and manifests beside it under ``path``-tiers."""

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    rules: dict[str, str]
    fan: int = 4
    buckets: int = 64

    @property
    def store(self) -> str:
        return f"{self.path.rstrip('/')}-tiers"

    def fold(self, rows: DataFrame) -> DataFrame:
        return merge.fold(rows, self.keys, self.rules, VERSION)


@dataclass(frozen=True)
class Run:
    """Fold of the batches ``first`` to ``last``; tier 0 is a batch's own folder."""

    folder: str
    first: int
    last: int
    tier: int


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _path(spark, folder)
    return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []


def _manifests(spark: SparkSession, table: Tiered) -> list[int]:
    return sorted(int(x.split(".")[0]) for x in _names(spark, f"{table.store}/manifests") if x.endswith(".json"))


def _runs_of(spark: SparkSession, table: Tiered, number: int) -> list[Run]:
    files, path = _path(spark, f"{table.store}/manifests/{number:012d}.json")
    stream = files.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return [Run(**x) for x in json.loads(text)]


def _switch(spark: SparkSession, table: Tiered, runs: list[Run]) -> None:
    """Name ``runs`` in a new manifest: written beside, then renamed, so a reader sees the old list or the new one."""
    number = max(_manifests(spark, table), default=-1) + 1
    files, new = _path(spark, f"{table.store}/manifests/{uuid.uuid4().hex}.part")
    out = files.create(new, False)
    out.write(bytearray(json.dumps([vars(r) for r in runs]).encode()))
    out.close()
    if not files.rename(new, _path(spark, f"{table.store}/manifests/{number:012d}.json")[1]):
        raise RuntimeError(f"manifest {number} of {table.path} was written by another run")


def runs(spark: SparkSession, table: Tiered) -> list[Run]:
    """What a read folds, oldest first: the newest manifest's runs, then the batches after them up to the first incomplete one."""
    known = _manifests(spark, table)
    named = _runs_of(spark, table, known[-1]) if known else []
    covered = named[-1].last if named else -1
    batches = sorted(int(x.removeprefix(f"{VERSION}=")) for x in _names(spark, table.path) if x.startswith(f"{VERSION}="))
    fresh = [Run(f"{table.path}/{VERSION}={n}", n, n, 0) for n in batches if n > covered]
    return named + list(takewhile(lambda r: "_SUCCESS" in _names(spark, r.folder), fresh))


def _rows(spark: SparkSession, table: Tiered, some: list[Run], bucket: int | None = None) -> DataFrame:
    def rows(run: Run) -> DataFrame:
        schema = table.schema if run.tier == 0 else T.StructType([*table.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        read = spark.read.schema(schema).parquet(run.folder)
        if bucket is not None and run.tier > 0:
            read = read.where(F.col(BUCKET) == bucket)
        return read.select(*table.schema.names, F.lit(run.last).cast("long").alias(VERSION))

    if not some:
        return spark.createDataFrame([], T.StructType([*table.schema.fields, T.StructField(VERSION, T.LongType())]))
    return reduce(DataFrame.union, map(rows, some))


def _bucketed(table: Tiered, rows: DataFrame) -> DataFrame:
    keys = [F.col(k) for k in table.keys]
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(table.buckets)).cast("int"))


def _due(found: list[Run], fan: int) -> tuple[int, int] | None:
    """Place and length of the oldest ``fan`` neighbours of one tier, lowest tier first."""
    for tier in sorted({r.tier for r in found}):
        at = [i for i, r in enumerate(found) if r.tier == tier]
        if len(at) >= fan:
            return at[0], fan
    return None


def compact(spark: SparkSession, table: Tiered, before: int | None = None) -> int:
    """Fold runs of the batches under ``before`` (all, if none) until no tier has ``fan`` of them; the number of runs written."""
    made = 0
    while due := _due(found := [r for r in runs(spark, table) if before is None or r.last < before], table.fan):
        start, n = due
        old = found[start : start + n]
        new = Run(f"{table.store}/runs/{uuid.uuid4().hex}", old[0].first, old[-1].last, old[0].tier + 1)
        folded = table.fold(_rows(spark, table, old)).select(*table.schema.names)
        _bucketed(table, folded).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(new.folder)
        # batches after the merged ones stay unnamed, so a manifest ends where its last run ends
        _switch(spark, table, [r for r in [*found[:start], new, *found[start + n :]] if r.tier > 0 or r.last < new.last])
        made += 1
    return made


def current(spark: SparkSession, table: Tiered) -> DataFrame:
    """The table as one batch run over everything would give it."""
    return table.fold(_rows(spark, table, runs(spark, table)))


def find(spark: SparkSession, table: Tiered, **key) -> DataFrame:
    """The row of one key, from one bucket of each run."""
    one = spark.createDataFrame([tuple(key[k] for k in table.keys)], T.StructType([table.schema[k] for k in table.keys]))
    bucket = _bucketed(table, one).first()[BUCKET]
    rows = _rows(spark, table, runs(spark, table), bucket)
    for k in table.keys:
        rows = rows.where(F.col(k).eqNullSafe(F.lit(key[k])))
    return table.fold(rows)


def superseded(spark: SparkSession, table: Tiered, keep: int = 2) -> list[str]:
    """Folders that the newest ``keep`` manifests don't need: merged batches and runs, and what a crash left behind.

    For a cleaner that runs when no compaction does; readers that began before the last switches still need theirs.
    """
    kept = [_runs_of(spark, table, n) for n in _manifests(spark, table)[-keep:]]
    named = {r.folder for found in kept for r in found}
    covered = min((found[-1].last for found in kept), default=-1)
    made = [f"{table.store}/runs/{x}" for x in _names(spark, f"{table.store}/runs")]
    batches = [x for x in _names(spark, table.path) if x.startswith(f"{VERSION}=") and int(x.removeprefix(f"{VERSION}=")) <= covered]
    return [x for x in made if x not in named] + [f"{table.path}/{x}" for x in batches]


def sync_tiered(source: DataFrame, table: Tiered, checkpoint: str, seq: str = "seq") -> StreamingQuery:
    """Fold each micro-batch into its version folder, then compact what is due."""

    def step(batch: DataFrame, batch_id: int) -> None:
        compact(batch.sparkSession, table, batch_id)  # this batch may yet be repeated
        merge.fold(batch, table.keys, table.rules, seq).write.mode("overwrite").parquet(f"{table.path}/{VERSION}={batch_id}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
