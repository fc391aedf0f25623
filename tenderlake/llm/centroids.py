"""Centroid clustering of bidder profiles with ns-bounds.

Each bidder keeps its cluster, an upper bound of its distance to that centroid, a
lower bound of its distance to all others, and the rounds in which the two were
measured. All centroids of the rounds so far are kept too (rounds x clusters x
entries, whatever the number of bidders). A bound is loosened by the norm of the
centroid's total displacement since the round in which it was measured, which is
never more than the sum of its drifts round by round. If the loosened bounds still
part, the cluster stands without a look at the profile; else the upper bound is
measured anew, and if that doesn't part them, all centroids are scanned exactly.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dropped, written
from .profiles import integers, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
# Share by which float bounds are widened, far above what rounding can lose.
SLACK = 1e-9


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids, as int64."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * top * top * points.shape[1] < 1 << 53:
        # every number on the way is an integer that a double holds
        x, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def displacements(history: np.ndarray) -> np.ndarray:
    """Norm of each centroid's way from every round to the last one: rounds x clusters, never too small."""
    way = (history[-1] - history).astype(np.float64)
    return np.sqrt((way * way).sum(axis=2)) * (1 + SLACK)


def reassign(points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, upper_round: np.ndarray, lower_round: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, ...]:
    """The bounds' arrays after an assignment to ``history[-1]``, and how many rows were scanned.

    Ties go to the smaller number: only bounds that part strictly spare a scan.
    """
    now, k = len(history) - 1, history.shape[1]
    cluster, upper, lower, upper_round, lower_round = (x.copy() for x in (cluster, upper, lower, upper_round, lower_round))
    old = np.flatnonzero(cluster >= 0)
    moved = displacements(history)
    # the largest way of all centroids but one
    others = np.stack([np.delete(moved, j, axis=1).max(axis=1, initial=0) for j in range(k)], axis=1)
    low = np.full(cluster.size, -np.inf)
    low[old] = lower[old] - others[lower_round[old], cluster[old]]
    high = np.full(cluster.size, np.inf)
    high[old] = upper[old] + moved[upper_round[old], cluster[old]]

    def open_rows(rows: np.ndarray) -> np.ndarray:
        return rows[~(high[rows] * (1 + SLACK) + SLACK < low[rows])]

    rows = open_rows(old)
    if rows.size:
        own = np.empty(rows.size, dtype=np.int64)
        for j in np.unique(cluster[rows]).tolist():
            mine = cluster[rows] == j
            own[mine] = squared(points[rows[mine]], history[-1][j : j + 1])[:, 0]
        high[rows] = upper[rows] = np.sqrt(own.astype(np.float64))
        upper_round[rows] = now
    rows = np.concatenate([open_rows(rows), np.flatnonzero(cluster < 0)])
    if rows.size:
        far = squared(points[rows], history[-1])
        cluster[rows] = far.argmin(axis=1)
        at = np.arange(rows.size)
        upper[rows] = np.sqrt(far[at, cluster[rows]].astype(np.float64))
        far[at, cluster[rows]] = np.iinfo(np.int64).max
        lower[rows] = np.sqrt(far.min(axis=1).astype(np.float64)) if k > 1 else np.inf
        upper_round[rows] = lower_round[rows] = now
    return cluster, upper, lower, upper_round, lower_round, rows.size


STATE = "cluster int, before int, upper double, lower double, upper_round int, lower_round int, scanned boolean, distance long"


def _assigned(table: DataFrame, history: np.ndarray, measure: bool) -> DataFrame:
    """``table`` after one assignment; with ``measure`` also the exact squared distance of every row."""
    schema = T.StructType([table.schema["bidder"], table.schema["point"], *T.StructType.fromDDL(STATE)])
    width = history.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(1).flatten().to_numpy().reshape(-1, width)
            before, upper, lower, upper_round, lower_round = (batch.column(i).to_numpy() for i in (2, 4, 5, 6, 7))
            state = reassign(points, before, upper, lower, upper_round, lower_round, history)
            cluster = state[0]
            scanned = state[4] == len(history) - 1
            distance = np.zeros(cluster.size, dtype=np.int64)
            if measure:
                for j in np.unique(cluster).tolist():
                    distance[cluster == j] = squared(points[cluster == j], history[-1][j : j + 1])[:, 0]
            columns = [cluster, before, *state[1:5], scanned, distance]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns)], names=schema.names)

    return table.mapInArrow(assign, schema)


def _changes(table: DataFrame, width: int) -> list:
    """Per cluster what the rows that came or left since the last round add to its entries' sums and its count."""
    moved = table.where(F.col("cluster") != F.col("before"))
    signed = F.array(F.struct(F.col("cluster").alias("cluster"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("cluster"), F.lit(-1).alias("sign")))
    each = moved.select("point", F.inline(signed)).where(F.col("cluster") >= 0)
    sums = [F.sum(F.col("point")[i] * F.col("sign")) for i in range(width)]
    return each.groupBy("cluster").agg(F.sum("sign").alias("n"), F.array(*sums).alias("sums")).collect()


def cluster_bidders(profiles: DataFrame, entries: int, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``bidder, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable profile, one row per input row.

    ``profiles``: ``bidder`` of any type and ``profile``, an array of numbers (see
    ``profiles.bidder_profiles``); other columns don't matter. Usable are profiles of
    exactly ``entries`` finite numbers; the others have no row. They count as
    integers ``floor(scale * x)``, so all sums and distances are exact and no order of
    tasks shows. Centroids start as the profiles with the smallest SHA-256 of
    ``<seed>:<bidder>`` (a null bidder is empty text, equal digests go by profile; fewer
    profiles give fewer clusters). Each round assigns every profile to the nearest
    centroid, ties to the smaller number, and moves each centroid to the floor of its
    members' mean; one without members stays. An empty table gives no rows.

    Every round reads and writes one narrow table, from which lost tasks start anew;
    the driver holds the centroids of all rounds and nothing that grows with the
    bidders.
    """
    most = math.isqrt((1 << 62) // max(entries, 1)) // 2
    usable = profiles.where(whole(F.col("profile")) & (F.size("profile") == entries))
    start = [F.lit(-1).alias("before"), *(F.lit(x).cast(t).alias(n) for n, t, x in (("upper", "double", 0), ("lower", "double", 0), ("upper_round", "int", 0), ("lower_round", "int", 0)))]
    fields = ["bidder", "point", "cluster", "before", "upper", "lower", "upper_round", "lower_round", "scanned", "distance"]
    points = usable.select(
        "bidder", integers(F.col("profile"), scale, most).alias("point"), F.lit(-1).alias("cluster"), *start, F.lit(True).alias("scanned"), F.lit(0).cast("long").alias("distance")
    ).select(*fields)
    table = written(points)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("bidder").cast("string"), F.lit(""))), 256)
    first = table.select(digest.alias("digest"), "point").orderBy("digest", "point").limit(clusters).collect()
    if not first or not entries:
        return _named(table.where(F.lit(False)), [], {})
    history = np.array([[r["point"] for r in first]], dtype=np.int64)
    counts, sums = [0] * len(first), [[0] * entries for _ in first]
    for turn in range(rounds + 1):
        last = turn == rounds
        newer = written(_assigned(table, history, last))
        dropped(table)
        table = newer
        if last:
            break
        for row in _changes(table, entries):
            j = row["cluster"]
            counts[j] += row["n"]
            sums[j] = [a + b for a, b in zip(sums[j], row["sums"])]
        centroids = [[s // counts[j] for s in sums[j]] if counts[j] else history[-1][j].tolist() for j in range(len(first))]
        history = np.concatenate([history, np.array([centroids], dtype=np.int64)])
    inertia = {r["cluster"]: int(r["inertia"]) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    return _named(table, history[-1].tolist(), inertia)


def _named(table: DataFrame, centroids: list[list[int]], inertia: dict[int, int]) -> DataFrame:
    """Result rows; the facts of the clusters are one small literal list."""
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    place = F.col("cluster") + 1
    own = F.element_at(F.array(*(F.lit(inertia.get(j, 0)).cast("long") for j in range(len(centroids)))), place) if centroids else F.lit(0).cast("long")
    digest = F.element_at(F.array(*map(F.lit, digests)), place) if centroids else F.lit("")
    return table.select("bidder", "cluster", "distance", own.alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), digest.alias("centroid_sha256"))
