import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import centroids, profiles, queries
from tenderlake.sources import star

from .helpers import CLASH, SF, SF_MORE


def brute(rows, entries, clusters=8, rounds=10, scale=1024, seed=3):
    """Lloyd's rounds with Python integers; ``rows`` are (bidder, profile)."""
    kept = [(b, [math.floor(scale * float(x)) for x in p]) for b, p in rows if p is not None and len(p) == entries and all(x is not None and math.isfinite(x) for x in p)]
    digest = lambda b: hashlib.sha256(f"{seed}:{'' if b is None else b}".encode()).hexdigest()
    centres = [p for _, p in sorted(((digest(b), p) for b, p in kept))[:clusters]]

    def nearest(p):
        far = [sum((x - y) ** 2 for x, y in zip(p, c)) for c in centres]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        place = [nearest(p)[0] for _, p in kept]
        for j in range(len(centres)):
            own = [p for (_, p), at in zip(kept, place) if at == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own)]
    last = [nearest(p) for _, p in kept]
    inertia = [sum(d for at, d in last if at == j) for j in range(len(centres))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((b, at, d, inertia[at], sum(inertia), shas[at]) for (b, _), (at, d) in zip(kept, last)), key=repr)


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "bidder string, profile array<double>")
    for name in (*CLASH, "point", "cluster", "upper", "distance", "inertia"):
        df = df.selectExpr("*", f"'clash' AS {name}") if name not in df.columns else df
    return df


@pytest.mark.parametrize("root", [SF, SF_MORE])
def test_embeddings_against_brute_force(spark, root):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{root}/embeddings.parquet").collect()]
    found = queries.op12_ns_centroids(spark, root)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert shown(found) == brute(rows, 64)


def test_odd_profiles(spark):
    rng = random.Random(5)
    rows = [(f"Bidder {i}", [rng.choice((0.0, 0.5, -0.25, 1 / 3)) for _ in range(3)]) for i in range(40)]
    rows += [("Bidder 1", rows[1][1]), ("Bidder 1", rows[2][1]), (None, [0.1, 0.2, 0.3]), (None, [0.1, 0.2, 0.3]), ("far", [5e5, -5e5, 0.0])]
    odd = [("null", None), ("short", [1.0, 2.0]), ("long", [1.0] * 4), ("none", []), ("gap", [1.0, None, 2.0]), ("nan", [1.0, float("nan"), 0.0]), ("inf", [float("inf"), 0.0, 0.0])]
    for clusters in (1, 3, 8):
        assert shown(centroids.cluster_bidders(frame(spark, rows + odd), 3, clusters, 4)) == brute(rows + odd, 3, clusters, 4)
    assert shown(centroids.cluster_bidders(frame(spark, rows[:2]), 3)) == brute(rows[:2], 3)
    assert centroids.cluster_bidders(frame(spark, odd), 3).count() == 0
    assert centroids.cluster_bidders(frame(spark, []), 3).count() == 0
    with pytest.raises(Exception, match="not supported"):
        centroids.cluster_bidders(frame(spark, [("huge", [1e300, 0.0, 0.0])]), 3)


def test_bounds_spare_scans_and_never_change_the_outcome():
    rng = np.random.default_rng(7)
    centres = rng.integers(-800, 800, (6, 5))
    points = np.concatenate([c + rng.integers(-90, 90, (200, 5)) for c in centres])
    history = points[:6][None].astype(np.int64)
    n = len(points)
    cluster = np.full(n, -1, dtype=np.int32)
    upper, lower = np.zeros(n), np.zeros(n)
    first, second = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    scans = []
    for _ in range(10):
        cluster, upper, lower, first, second, scanned = centroids.reassign(points, cluster, upper, lower, first, second, history)
        plain = ((points[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert (cluster == plain.argmin(axis=1)).all()
        scans.append(scanned)
        centre = np.array([points[cluster == j].sum(axis=0) // max((cluster == j).sum(), 1) if (cluster == j).any() else history[-1][j] for j in range(6)])
        history = np.concatenate([history, centre[None]])
    assert scans[0] == n and sum(scans[5:]) < n


def test_total_displacement_loosens_less_than_summed_drifts():
    """A centroid that goes away and comes back leaves the bound as it was measured."""
    points = np.array([[0, 0], [100, 0]])
    there = np.array([[[0, 0], [100, 0]], [[40, 0], [100, 0]], [[0, 0], [100, 0]]])
    state = centroids.reassign(points, np.full(2, -1), np.zeros(2), np.zeros(2), np.zeros(2, dtype=int), np.zeros(2, dtype=int), there[:1])
    assert centroids.displacements(there).tolist()[0] == [0.0, 0.0]
    assert centroids.reassign(points, *state[:5], there)[-1] == 0


def test_distances_are_exact_beyond_doubles():
    points = np.array([[1 << 29, -(1 << 29), 3], [5, 6, 7]])
    found = centroids.squared(points, np.array([[-(1 << 29), 1 << 29, 4]]))
    assert found.tolist() == [[2 * (1 << 60) + 1], [(5 + (1 << 29)) ** 2 + (6 - (1 << 29)) ** 2 + 9]]


def test_profiles_of_landed_bidders(spark):
    participants = spark.createDataFrame(
        [("1", "SIA Alfa"), ("1", "SIA Alfa"), ("2", "Alfa SIA"), ("3", "Beta"), ("4", None), ("9", "Gamma")], "procurement_id string, participant_name string"
    )
    announcements = spark.createDataFrame([("1", "45000000-7"), ("2", "71000000-8"), ("2", "71000000-8"), ("3", "45200000"), ("4", "45"), ("9", "x")], "procurement_id string, cpv_main string")
    made = {r["bidder"]: r["profile"] for r in profiles.bidder_profiles(participants, announcements).collect()}
    assert set(made) == {"ALFA", "BETA"} and all(len(p) == profiles.DIVISIONS and sum(p) == 1 for p in made.values())
    assert (made["ALFA"][44], made["ALFA"][70], made["BETA"][44]) == (0.5, 0.5, 1.0)
    rows = list(made.items())
    assert shown(centroids.cluster_bidders(profiles.bidder_profiles(participants, announcements), profiles.DIVISIONS, 2)) == brute(rows, profiles.DIVISIONS, 2)


def test_bidders_of_the_market(spark):
    made = profiles.bidder_profiles(star.participants(spark, SF), star.announcements(spark, SF))
    rows = list(map(tuple, made.select("bidder", "profile").collect()))
    assert rows and shown(centroids.cluster_bidders(made, profiles.DIVISIONS, 4, 5)) == brute(rows, profiles.DIVISIONS, 4, 5)
