import math
import random

import numpy as np
import pytest

from tenderlake.llm import profiles, queries, whitening
from tenderlake.sources import star

from .helpers import CLASH, SF, SF_MORE


def brute(rows, components=4, scale=256):
    """Per row and component: (bidder, component, n, deviation, |whitened|, explained)."""
    whole = [(b, [math.floor(scale * float(x)) for x in p]) for b, p in rows if p and all(x is not None and math.isfinite(x) for x in p)]
    width = max((len(p) for _, p in whole), default=0)
    whole = [(b, p) for b, p in whole if len(p) == width]
    fit = sorted({tuple(p) for _, p in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    out = []
    if not n:
        return out
    centred = np.array(fit, dtype=float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    for b, p in whole:
        deviation = sum((n * x - s) ** 2 for x, s in zip(p, sums))
        for j in range(min(components, width)):
            flat = values[j] <= 1e-12 * max(values[0], 0) or values[j] <= 0
            white = None if flat else abs(float((np.array(p) - np.array(sums) / n) @ vectors[:, j] / math.sqrt(values[j])))
            out.append((b, j + 1, n, deviation, white, float(values[j] / values.sum()) if values[0] > 0 else None))
    return out


def agree(found, rows, **more):
    want = sorted(brute(rows, **more), key=lambda r: (str(r[0]), r[1], r[3], r[4] or 0))
    have = sorted(((r[0], r[1], r[2], r[3], None if r[4] is None else abs(r[4]), r[5]) for r in found), key=lambda r: (str(r[0]), r[1], r[3], r[4] or 0))
    assert [r[:4] for r in have] == [r[:4] for r in want]
    for h, w in zip(have, want):
        for x, y in zip(h[4:], w[4:]):
            assert (x is None and y is None) or x == pytest.approx(y, rel=1e-7, abs=1e-9)
    errors = {r[6] for r in found}
    assert len(errors) <= 1 and all(e is None or e < 1e-9 for e in errors)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "bidder string, profile array<double>")
    for name in (*CLASH, "point", "index", "vector", "part", "place", "component", "whitened"):
        df = df.selectExpr("*", f"'clash' AS {name}") if name not in df.columns else df
    return df


@pytest.mark.parametrize("root", [SF, SF_MORE])
def test_embeddings_against_numpy(spark, root):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{root}/embeddings.parquet").collect()]
    found = queries.op13_block_whitening(spark, root)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agree(found.collect(), rows)


def test_signs_are_the_same_for_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i), [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    found = whitening.whiten_bidders(frame(spark, rows)).collect()
    fit = np.array([[math.floor(256 * x) for x in p] for _, p in rows], dtype=float)
    place = {b: i for i, (b, _) in enumerate(rows)}
    white = np.zeros((300, 3))
    for r in found:
        white[place[r["bidder"]], r["component"] - 1] = r["whitened"]
    # projections of one orthogonal system: whitened distances are Mahalanobis distances
    precision = np.linalg.inv(np.cov(fit.T, bias=True))
    d = fit[:50] - fit[50:100]
    assert np.allclose(((white[:50] - white[50:100]) ** 2).sum(axis=1), np.einsum("ij,jk,ik->i", d, precision, d))


def test_many_blocks_and_rare_values(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LEAST_ROWS", 7)
    rng = random.Random(4)
    # two columns take part by themselves, so eigenvalues stay apart
    rows = [(str(i), [rng.gauss(0, 1 + 3 * j) for j in range(6)]) for i in range(120)]
    rows += [("copy", rows[3][1])] * 30 + [(None, rows[4][1]), (None, rows[4][1])]
    agree(whitening.whiten_bidders(frame(spark, rows)).collect(), rows)


def test_odd_profiles(spark):
    rng = random.Random(6)
    good = [(str(i), [rng.uniform(-2, 2), 4 * rng.uniform(-2, 2), 0.5]) for i in range(20)]
    odd = [("null", None), ("none", []), ("gap", [1.0, None, 2.0]), ("nan", [1.0, float("nan"), 0.0]), ("inf", [float("-inf"), 0.0, 0.0]), ("short", [1.0])]
    agree(whitening.whiten_bidders(frame(spark, good + odd)).collect(), good + odd)
    agree(whitening.whiten_bidders(frame(spark, good), components=2).collect(), good, components=2)
    for rows in (good[:1], [("a", [1.0, 2.0]), ("b", [1.0, 2.0])], [("one", [1.0]), ("two", [3.0])]):
        agree(whitening.whiten_bidders(frame(spark, rows)).collect(), rows)
    for rows in ([], odd[:5]):
        found = whitening.whiten_bidders(frame(spark, rows))
        assert found.count() == 0 and "identity_error" in found.columns
    with pytest.raises(Exception, match="not supported"):
        whitening.whiten_bidders(frame(spark, [("huge", [1e300])])).collect()


def test_deviation_beyond_a_long_is_null(spark):
    rows = [("a", [3e9, 0.0]), ("b", [-3e9, 1.0]), ("c", [0.0, 5.0])]
    found = {(r["bidder"], r["component"]): r["deviation"] for r in whitening.whiten_bidders(frame(spark, rows)).collect()}
    assert found["a", 1] is None and found["c", 1] is not None


def test_bidders_of_the_market(spark):
    made = profiles.bidder_profiles(star.participants(spark, SF), star.announcements(spark, SF))
    found = whitening.whiten_bidders(made, components=1).collect()
    assert {r["bidder"] for r in found} == {r["bidder"] for r in made.collect()}
    assert {r["deviation"] for r in found} == {r[3] for r in brute(list(map(tuple, made.select("bidder", "profile").collect())), 1)}
