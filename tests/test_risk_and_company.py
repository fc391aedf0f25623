"""Risk and company views on small hand-made markets."""

from __future__ import annotations

import itertools
import json
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import facts
from tenderlake.plans import company, dashboard, purchaser, risk
from tenderlake.sources.schemas import MARKET_ROWS, with_optional_columns

RISK = (
    "procurement_id string, procurement_winner string, winner_normalized string, purchaser_name string, planning_region string, "
    "category string, award double, estimate double, bidders int, participants string, evaluation_method string"
)


def people(*pairs):
    return json.dumps([{"name": n, "suggested_price_eur": p} for n, p in pairs], ensure_ascii=False)


def market(spark, rows):
    raw = spark.createDataFrame(rows, RISK).select(
        "procurement_id", "procurement_winner", "winner_normalized", "purchaser_name", "planning_region", "category", "evaluation_method",
        F.col("award").cast("decimal(18,2)").alias(facts.AWARD), F.col("estimate").cast("decimal(18,2)").alias(facts.ESTIMATE),
        F.col("bidders").alias(facts.COUNT), F.col("participants").alias("procurement_participants_json"),
    )
    full = with_optional_columns(raw, MARKET_ROWS)
    return full.withColumns({"winner_display_name": F.col("winner_normalized"), "buyer_normalized": F.upper("purchaser_name")})


@pytest.fixture(scope="module")
def risky(spark):
    a, low = ("Buyer A", "Rīga", "design"), "lowest_price"
    return market(spark, [
        ("1", "Acme", "ACME", *a, 100.0, None, 4, people(("SIA Acme", 100), ("Beta", 102)), low),
        ("2", "SIA Acme", "ACME", *a, 110.0, None, 4, people(("Acme", 110), ("Beta", 111)), low),
        ("3", 'SIA "ACME"', "ACME", *a, 120.0, None, 4, people(('SIA "ACME"', 120), ("Beta", 122)), low),
        ("4", "Acme", "ACME", *a, 120.0, 100.0, 1, None, None),
        ("5", "Acme", "ACME", *a, 75.0, 100.0, 3, None, None),
        *[(str(i), "SafeCo", "SAFECO", "Buyer Safe", "Kurzeme", "maintenance", p, None, None, None, None) for i, p in ((6, 55.0), (7, 60.0), (8, 65.0))],
    ])


def test_risk_view(risky):
    bids = facts.bids_from_json(risky)
    priced = risk.priced_bids(risky, bids)
    flagged = risk.risk_rows(risky, priced).cache()
    s = risk.summary(flagged).first()
    assert (s.projects, s.single_bidder_count, s.low_competition_count, s.with_estimate_count) == (8, 1, 1, 2)
    assert (s.award_above_estimate_count, s.award_above_estimate_10pct_count, s.award_below_estimate_20pct_count) == (1, 1, 1)
    winners = {r.name: r for r in risk.risky_winners(flagged).collect()}
    assert set(winners) == {"Acme", "SafeCo"} and winners["SafeCo"].risky_project_count == 0
    acme = winners["Acme"]
    assert (acme.project_count, acme.risky_project_count, acme.single_bidder_wins, acme.above_estimate_wins) == (5, 4, 1, 1)
    spots = {(r.kind, r.name): r for r in risk.hotspots(flagged).collect()}
    assert [n for k, n in spots if k == "buyer"] == ["Buyer A"]
    assert spots["region", "Rīga"].risky_project_count == 4 and spots["category", "design"].risky_project_count == 4
    pair = risk.repeated_pairs(priced).collect()
    assert [(p.close_bid_count, p.meet_count, p.lowest_price_close_count) for p in pair] == [(3, 3, 3)]
    assert risk.single_bidder_buyers(risky).first().name == "Buyer A"
    assert risk.buyer_concentration(risky).first().top_winner == "ACME"


def plain_pairs(bids):
    counts = {}
    for _, group in itertools.groupby(sorted(bids), key=lambda b: b[0]):
        for x, y in itertools.combinations(list(group), 2):
            key = tuple(sorted((x[2], y[2])))
            low, high = sorted((x[3], y[3]))
            c = counts.setdefault(key, [0, 0])
            c[0] += 1
            c[1] += low > 0 and high - low <= low * Decimal("0.03")
    return {k: tuple(v) for k, v in counts.items() if v[1] >= 3}


def pair_frame(spark, bids):
    return spark.createDataFrame(bids, "procurement_id string, pos long, norm_name string, price decimal(18,2)").withColumn("lowest", F.lit(False))


@pytest.mark.parametrize("share", [256, 4])
@pytest.mark.parametrize("names", [30, 200])
def test_close_pairs_equal_all_pairs(spark, monkeypatch, share, names):
    """Crowded and small procurements, bidders seen often and rarely, names repeated within a procurement."""
    monkeypatch.setattr(risk, "BAND_SHARE", share)
    rng = random.Random(share + names)
    bids = []
    for p in range(14):
        size = 40 if p % 3 == 0 else 8
        for pos in range(size):
            name = f"N{rng.randrange(names)}"
            bids += [(f"p{p}", 2 * pos + i, name, Decimal(rng.choice([0, 100, 101, 102, 103, 104, 110, 200, 203, 206]))) for i in range(rng.choice([1, 1, 1, 2]))]
    got = {tuple(r.name.split(" · ")): (r.meet_count, r.close_bid_count) for r in risk.repeated_pairs(pair_frame(spark, bids), None).collect()}
    assert got == plain_pairs(bids)


def test_rare_bidder_with_a_repeated_name_is_found(spark):
    filler = [(p, 10 + i, f"F{p}{i}", Decimal(1000 * (i + 2))) for p in ("p1", "p2") for i in range(3)]
    bids = [("p1", 0, "A", Decimal(100)), ("p1", 1, "B", Decimal(101)), ("p1", 2, "B", Decimal(102)), ("p2", 0, "A", Decimal(100)), ("p2", 1, "B", Decimal(101))]
    rows = risk.close_pair_counts(pair_frame(spark, bids + filler)).collect()
    assert [(r.a, r.b, r.close) for r in rows] == [("A", "B", 3)]


def test_bidders_that_can_be_in_no_pair_form_no_pairs(spark):
    """One crowded band of bidders met once each, two regulars beside it, and prices that only neighbour bands hold."""
    crowd = [("p0", i, f"C{i}", Decimal(100)) for i in range(60)]
    regulars = [(f"q{p}", i, name, Decimal(price)) for p in range(3) for i, (name, price) in enumerate((("A", 100), ("B", 103), ("D", 200)))]
    odd = [("r", i, "Z", Decimal(x)) for i, x in enumerate((0, -5))] + [("p0", 99, "A", Decimal(100))]
    bids = pair_frame(spark, crowd + regulars + odd)
    left = risk.pair_candidates(bids)
    assert {r.norm_name for r in left.select("norm_name").distinct().collect()} == {"A", "B"}
    assert risk._near_pairs(bids).count() > 1800 and risk._near_pairs(left).count() == 3
    assert [(r.a, r.b, r.close) for r in risk.close_pair_counts(bids).collect()] == [("A", "B", 3)]


def test_only_bids_close_to_another_go_on(spark):
    """Bids alone in their prices, also at the ends of blocks and without a neighbour, are left before any later step."""
    edge = math.exp(risk._BAND * risk.BLOCK_BANDS * 10)
    prices = [("p", x) for x in (0, -5, 100, 103, 107, 300, 400, 400, edge * 0.99, edge * 1.01, edge * 2)] + [("q", 100), ("q", None), (None, 50), (None, 51)]
    bids = [(p, i, f"N{i}", None if x is None else Decimal(f"{x:.2f}")) for i, (p, x) in enumerate(prices)]
    frame = pair_frame(spark, bids)
    assert {r.pos for r in risk.near_bids(frame).collect()} == {2, 3, 6, 7, 8, 9, 13, 14}


def test_first_pairs_are_the_head_of_all_pairs(spark):
    rng = random.Random(5)
    bids = [(f"p{p}", i, f"N{rng.randrange(6)}", Decimal(rng.choice([100, 101, 102, 104, 200, 203]))) for p in range(25) for i in range(4)]
    frame = pair_frame(spark, bids)
    every = risk.repeated_pairs(frame, None).collect()
    for k in (1, 3, 7, 100):
        assert risk.repeated_pairs(frame, k).collect() == every[:k]
    assert risk.repeated_pairs(frame.limit(0)).collect() == []


@pytest.fixture(scope="module")
def alpha(spark):
    ctx = ("Buyer", "Rīga", "design")
    rows = market(spark, [
        ("1", "Alpha Build", "ALPHA BUILD", *ctx, 100.0, 100.0, 2, people(("Alpha Build", 100), ("Gamma", 105)), None),
        ("2", "Gamma", "GAMMA", *ctx, 95.0, 100.0, 2, people(("Beta Construct", 98), ("Gamma", 95)), None),
        ("3", "Beta Construct", "BETA CONSTRUCT", *ctx, 90.0, 100.0, 3, people(("Alpha Build", 94), ("Beta Construct", 90), ("Gamma", 97)), None),
    ])
    return rows.withColumn("cpv_main", F.lit("45210000-2"))


def test_company_view(spark, alpha):
    bids = facts.bids_from_json(alpha)
    chosen = company.selection(spark, bids, ["Alpha Build", "Beta Construct"])
    ours = company.company_rows(alpha, bids, chosen)
    s = company.summary(ours).first()
    assert (s.applications, s.wins, s.losses, s.won_value_eur, s.close_losses_3pct) == (3, 2, 1, 190.0, 0)
    assert s.avg_losing_gap_pct == 3.16 and s.avg_winning_margin_pct == 4.72
    best = [r for r in company.buyer_rankings(company.buyers(ours, alpha)).collect() if r.ranking == "best"][0]
    assert (best.bids, best.wins) == (3, 2)
    gamma = company.rivals(ours, bids, chosen).first()
    assert (gamma.name, gamma.meet_count, gamma.beat_us, gamma.we_beat) == ("Gamma", 3, 1, 2)
    assert company.label(bids, chosen).first().selected_company == "Alpha Build · Beta Construct"


def test_default_selection_is_the_first_option(spark, alpha):
    bids = facts.bids_from_json(alpha)
    assert [r.name for r in company.selection(spark, bids).collect()] == ["Alpha Build"]
    assert purchaser.summary(purchaser.purchaser_rows(alpha, bids)).first().projects == 3


def test_leaderboard_counts_each_bidder_once_per_row(spark):
    rows = market(spark, [("1", "B", "B", "Buyer", "Rīga", "design", 90.0, None, 3, people(("SIA A", 91), ("A", 95), ("B", 90), ("", 1)), None)])
    table = {r.name: r for r in dashboard.bidder_table(rows, facts.bids_from_json(rows)).collect()}
    assert set(table) == {"SIA A", "B"}
    assert (table["SIA A"].applications, table["SIA A"].total_bid_value_eur, table["SIA A"].close_losses_3pct) == (1, 91.0, 1)
    assert (table["B"].wins, table["B"].won_value_eur) == (1, 90.0)


def test_empty_market_gives_nulls_not_errors(spark):
    rows = market(spark, [])
    assert dashboard.overview(rows).first().single_bidder_share_pct is None
    assert dashboard.concentration(rows).first().hhi is None
    assert dashboard.multi_lot(rows).first().average_lots_per_multi_lot_project is None
    assert risk.repeated_pairs(risk.priced_bids(rows, facts.bids_from_json(rows))).collect() == []
