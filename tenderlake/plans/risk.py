"""Risk screens: single bidders, awards over estimate, repeatedly close bidder pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.cleaning import pct
from ..operators.facts import AWARD, COUNT, ESTIMATE, WINNER, amount, has_winner, total
from ..operators.ranking import top
from ..session import written

CLOSE = "0.03"
MIN_CLOSE = 3
BAND_SHARE = 256
# Bands of a block inside which bids are ordered by price to find those that are close to any other.
BLOCK_BANDS = 32
_BAND = math.log(1.0301)


def priced_bids(rows: DataFrame, bids: DataFrame) -> DataFrame:
    """Priced bids of named bidders with their row's evaluation method.

    Written once, since the pair screen reads them several times, each time
    with other columns.
    """
    lowest = F.coalesce(F.col("evaluation_method") == "lowest_price", F.lit(False))
    return written(
        bids.where((F.col("norm_name") != fixed.NO_PARTY) & F.col("price").isNotNull())
        .join(rows.select("procurement_id", lowest.alias("lowest")), "procurement_id")
        .select("procurement_id", "pos", "norm_name", "price", "lowest")
    )


def _is_close(p: Column, q: Column) -> Column:
    low, high = F.least(p, q), F.greatest(p, q)
    return (low > 0) & (high - low <= low * F.lit(CLOSE).cast("decimal(3,2)"))


def _band() -> Column:
    return F.floor(F.log(F.col("price").cast("double")) / _BAND)


def near_bids(priced: DataFrame) -> DataFrame:
    """Bids that are close to some other bid of their procurement.

    A bid that is close to any other is close to the one before or after it by
    price, so one look at both neighbours decides. Bids are ordered inside blocks of
    ``BLOCK_BANDS`` bands; those of a block's first and last band are shown to the block
    beside it. Most bids are close to none, and all later steps are spared them.
    """
    banded = priced.where(F.col("price") > 0).withColumn("band", _band())
    block = lambda band: F.floor(band / BLOCK_BANDS)
    shown = banded.withColumn("block", F.explode(F.array_distinct(F.array(*[block(F.col("band") + step) for step in (0, -1, 1)]))))
    by_price = Window.partitionBy("procurement_id", "block").orderBy("price")
    near = lambda other: other.isNotNull() & _is_close(F.col("price"), other)
    seen = shown.withColumn("near", near(F.lag("price").over(by_price)) | near(F.lead("price").over(by_price)))
    return seen.where(F.col("near") & (F.col("block") == block(F.col("band")))).select(*priced.columns)


def _near_pairs(bids: DataFrame) -> DataFrame:
    """Close pairs of one procurement, met through price bands only.

    Two close prices lie in the same or in neighbouring bands of 3 %, so the
    join key is (procurement, band); no other pair of the procurement is formed.
    The bids of a band are dealt by hash over as many salts as it has shares of
    ``BAND_SHARE`` bids, and the other side is copied to each, so that a crowded
    band is shared by more tasks the larger it is. Crowded bands are written, so that
    bids stay where they are while these are few.
    """
    banded = bids.where(F.col("price") > 0).withColumn("band", _band())
    sizes = written(banded.groupBy("procurement_id", "band").agg(F.ceil(F.count(F.lit(1)) / BAND_SHARE).cast("int").alias("salts")).where(F.col("salts") > 1))
    salts = F.coalesce("salts", F.lit(1))
    left = banded.join(sizes, ["procurement_id", "band"], "left").select(
        "procurement_id", "band", F.col("norm_name").alias("n1"), F.col("pos").alias("p1"), F.col("price").alias("v1"), "lowest",
        F.pmod(F.xxhash64("norm_name", "pos"), salts).cast("int").alias("salt"),
    )
    right = banded.select(
        "procurement_id", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("own"),
        F.col("norm_name").alias("n2"), F.col("pos").alias("p2"), F.col("price").alias("v2"),
    )
    right = right.join(sizes, ["procurement_id", "band"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    once = (F.col("own") < F.col("band")) | (F.col("p1") < F.col("p2"))
    return (
        left.join(right, ["procurement_id", "band", "salt"])
        .where(once & _is_close(F.col("v1"), F.col("v2")))
        .select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b"), "lowest")
    )


def pair_candidates(priced: DataFrame, min_close: int = MIN_CLOSE) -> DataFrame:
    """Bids of bidders that can be in a pair of at least ``min_close`` close meetings; no pair is formed.

    One bid is close to no more bids of any one bidder than that bidder has in the
    bid's own band and in those neighbour bands whose nearest price is close. The
    most that any bidder has there bounds it, and a bidder's bounds are summed.
    """
    banded = priced.where(F.col("price") > 0).withColumn("band", _band())
    own = banded.groupBy("procurement_id", "band", "norm_name").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))
    cells = own.groupBy("procurement_id", "band").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))
    # each cell tells itself and both neighbours what it holds
    told = cells.select(
        "procurement_id",
        F.inline(F.array(*[F.struct((F.col("band") + step).alias("band"), F.lit(step).alias("step"), "n", "most", "low", "high") for step in (-1, 0, 1)])),
    )
    seen = lambda step, name: F.max(F.when(F.col("step") == step, F.col(name)))
    around = told.groupBy("procurement_id", "band").agg(
        F.least(seen(0, "most"), seen(0, "n") - 1).alias("here"),
        seen(1, "high").alias("below"), seen(1, "most").alias("n_below"), seen(-1, "low").alias("above"), seen(-1, "most").alias("n_above"),
    ).where(F.col("here").isNotNull())
    near = lambda other, n: F.when(F.col(other).isNotNull() & _is_close(F.col("price"), F.col(other)), F.col(n)).otherwise(0)
    bound = banded.join(around, ["procurement_id", "band"]).select("norm_name", (F.col("here") + near("below", "n_below") + near("above", "n_above")).alias("most"))
    able = written(bound.groupBy("norm_name").agg(F.sum("most").alias("most")).where(F.col("most") >= min_close).select("norm_name"))
    return priced.join(able, "norm_name", "left_semi").select(*priced.columns)


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("close"), F.count_if("lowest").alias("lowest"))


def _meetings(pairs: DataFrame, bids: DataFrame) -> DataFrame:
    """Every meeting of the given pairs; a pair with itself counts once per meeting.

    The bidder with fewer bids leads: its bids are joined first and the other
    one is looked up by (procurement, name), so a bidder found everywhere never
    multiplies its bids by its partners. Pairs are written, so that their size decides
    whether bids move to meet them; places go along only where a bidder meets itself.
    """
    seen = bids.groupBy("norm_name").agg(F.count(F.lit(1)).alias("n"))
    sized = (
        pairs.select("a", "b")
        .join(seen.select(F.col("norm_name").alias("a"), F.col("n").alias("na")), "a")
        .join(seen.select(F.col("norm_name").alias("b"), F.col("n").alias("nb")), "b")
    )
    leader_first = F.col("na") <= F.col("nb")
    led = written(
        sized.select(
            F.when(leader_first, F.col("a")).otherwise(F.col("b")).alias("leader"), F.when(leader_first, F.col("b")).otherwise(F.col("a")).alias("partner"),
        )
    )
    alone = F.col("leader") == F.col("partner")
    first = bids.select("procurement_id", F.col("norm_name").alias("leader"), F.col("pos").alias("p1"))
    second = bids.select("procurement_id", F.col("norm_name").alias("partner"), F.col("pos").alias("p2"))
    met = led.join(first, "leader").withColumn("p1", F.when(alone, F.col("p1"))).join(second, ["procurement_id", "partner"])
    return met.where(~alone | (F.col("p1") < F.col("p2"))).select(
        "procurement_id", F.least("leader", "partner").alias("a"), F.greatest("leader", "partner").alias("b")
    )


def close_pair_counts(priced: DataFrame, min_close: int = MIN_CLOSE) -> DataFrame:
    """Pairs with at least ``min_close`` close meetings: ``a, b, close, lowest``, the same way for every procurement."""
    near = written(near_bids(priced))
    return _counted(_near_pairs(pair_candidates(near, min_close))).where(F.col("close") >= min_close)


def repeated_pairs(priced: DataFrame, k: int | None = 15, min_close: int = MIN_CLOSE) -> DataFrame:
    """Bidder pairs close at least three times, with all their meetings.

    Close meetings come first in the order, so with ``k`` given only pairs with at
    least as many as the ``k``-th need their meetings found.
    """
    close = written(close_pair_counts(priced, min_close))
    if k:
        # at most k numbers
        most = [r["close"] for r in close.select("close").orderBy(F.desc("close")).limit(k).collect()]
        close = close.where(F.col("close") >= min(most, default=0))
    met = _meetings(close, priced).groupBy("a", "b").agg(F.count(F.lit(1)).alias("meet_count"))
    shown = close.join(met, ["a", "b"]).select(
        F.concat_ws(" · ", "a", "b").alias("name"),
        F.col("close").alias("close_bid_count"),
        "meet_count",
        F.col("lowest").alias("lowest_price_close_count"),
        pct(F.col("close"), F.col("meet_count")).alias("close_share_pct"),
    )
    return top(shown, k, F.desc("close_bid_count"), F.desc("meet_count"), F.asc("name"))


def flagged_rows(rows: DataFrame) -> DataFrame:
    """Rows with the flags that their own values decide."""
    award, guess, bidders = F.col(AWARD), F.col(ESTIMATE), F.col(COUNT)
    usable = F.coalesce((award != 0) & (guess != 0), F.lit(False))
    flags = {
        "single_bidder": F.coalesce(bidders == 1, F.lit(False)),
        "low_competition": F.coalesce(bidders <= 2, F.lit(False)),
        "with_estimate": usable,
        "above_estimate": usable & (award > guess),
        "above_estimate_10pct": usable & (award > guess * F.lit("1.1").cast("decimal(2,1)")),
        "below_estimate_20pct": usable & (award < guess * F.lit("0.8").cast("decimal(2,1)")),
    }
    return rows.withColumns(flags)


def risk_rows(rows: DataFrame, priced: DataFrame) -> DataFrame:
    """Rows with their risk flags; ``priced`` comes from ``priced_bids``."""
    paired = _meetings(written(close_pair_counts(priced)), priced).select("procurement_id").distinct()
    marked = paired.withColumn("close_pair", F.lit(True))
    flagged = flagged_rows(rows).join(marked, "procurement_id", "left").withColumn("close_pair", F.coalesce("close_pair", F.lit(False)))
    risky = F.col("single_bidder") | F.col("low_competition") | F.col("above_estimate") | F.col("above_estimate_10pct") | F.col("close_pair")
    return flagged.withColumn("risky", risky)


def summary(flagged: DataFrame) -> DataFrame:
    """Counts and shares of the flags; ``flagged_rows`` is enough, no pair is asked for."""
    n, guessed = F.count(F.lit(1)), F.count_if("with_estimate")
    counts = {"single_bidder": n, "low_competition": n}
    counts.update({f"award_{x}": guessed for x in ("above_estimate", "above_estimate_10pct", "below_estimate_20pct")})
    out = [n.alias("projects"), guessed.alias("with_estimate_count")]
    for name, base in counts.items():
        hits = F.count_if(name.removeprefix("award_"))
        out += [hits.alias(f"{name}_count"), pct(hits, base).alias(f"{name}_share_pct")]
    return flagged.agg(*out)


def hotspots(flagged: DataFrame, k: int = 10, min_projects: int = 5) -> DataFrame:
    """Risk per buyer, region and category in one aggregation; the top ``k`` of each kind."""
    kinds = {
        "buyer": ("purchaser_name", fixed.NO_PARTY),
        "region": ("planning_region", fixed.NO_REGION),
        "category": ("category", fixed.NO_CATEGORY),
    }
    pairs = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(none)).alias("name"))
        for kind, (col, none) in kinds.items()
    ])
    spread = flagged.select(F.explode(pairs).alias("p"), "risky", "single_bidder", "above_estimate", AWARD)
    counted = spread.groupBy("p.kind", "p.name").agg(
        F.count(F.lit(1)).alias("project_count"),
        F.count_if("risky").alias("risky_project_count"),
        pct(F.count_if("risky"), F.count(F.lit(1))).alias("risky_project_share_pct"),
        F.count_if("single_bidder").alias("single_bidder_count"),
        F.count_if("above_estimate").alias("above_estimate_count"),
        total(amount()).alias("awarded_sum_eur"),
    )
    order = Window.partitionBy("kind").orderBy(
        F.desc("risky_project_share_pct"), F.desc("risky_project_count"), F.desc("awarded_sum_eur"), F.asc("name")
    )
    kept = counted.where(F.col("project_count") >= min_projects).withColumn("_rank", F.row_number().over(order))
    return kept.where(F.col("_rank") <= k).drop("_rank")


def risky_winners(flagged: DataFrame, k: int = 10, min_projects: int = 3) -> DataFrame:
    """Winners by risky share; the shown spelling is the first in dashboard order."""
    from ..functions.names import display_name

    won = flagged.where(has_winner())
    first = F.max_by(display_name(F.col(WINNER)), F.struct("year", "procurement_id"))
    counted = won.groupBy("winner_normalized").agg(
        first.alias("name"),
        F.count(F.lit(1)).alias("project_count"),
        F.count_if("risky").alias("risky_project_count"),
        pct(F.count_if("risky"), F.count(F.lit(1))).alias("risky_project_share_pct"),
        total(amount()).alias("awarded_sum_eur"),
        total(F.when(F.col("risky"), amount())).alias("risky_awarded_sum_eur"),
        F.count_if("single_bidder").alias("single_bidder_wins"),
        F.count_if("above_estimate").alias("above_estimate_wins"),
    )
    order = (F.desc("risky_project_share_pct"), F.desc("risky_project_count"), F.desc("awarded_sum_eur"), F.asc("name"))
    return top(counted.where(F.col("project_count") >= min_projects).drop("winner_normalized"), k, *order)


def _buyer_name() -> Column:
    return F.coalesce(F.nullif(F.col("purchaser_name"), F.lit("")), F.lit(fixed.NO_PARTY))


def single_bidder_buyers(rows: DataFrame, k: int = 10, min_projects: int = 5) -> DataFrame:
    """Single-bidder share per buyer among rows whose bidder count is known."""
    single = F.count_if(F.col(COUNT) == 1)
    counted = (
        rows.where(F.col(COUNT).isNotNull())
        .groupBy(_buyer_name().alias("name"))
        .agg(
            F.count(F.lit(1)).alias("project_count"),
            single.alias("single_bidder_count"),
            total(amount()).alias("awarded_sum_eur"),
            pct(single, F.count(F.lit(1))).alias("single_bidder_share_pct"),
        )
        .where(F.col("project_count") >= min_projects)
    )
    return top(counted, k, F.desc("single_bidder_share_pct"), F.desc("project_count"), F.asc("name"))


def buyer_concentration(rows: DataFrame, k: int = 10, min_awarded: int = 5) -> DataFrame:
    """Top winner share per buyer; the value covers all rows of the buyer.

    Rows without a winner stay in the (buyer, winner) cells under a null winner,
    so one aggregation serves both the counts and the buyer's total.
    """
    winner = F.when(has_winner(), F.col("winner_normalized"))
    cells = (
        rows.where(F.coalesce(F.col("purchaser_name") != "", F.lit(False)))
        .groupBy(F.col("purchaser_name").alias("name"), winner.alias("winner"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(amount()).alias("v"))
    )
    won = F.when(F.col("winner").isNotNull(), F.col("n"))
    best = F.min_by(F.struct("winner", "n"), F.when(F.col("winner").isNotNull(), F.struct(-F.col("n"), F.col("winner"))))
    counted = cells.groupBy("name").agg(F.sum(won).alias("n"), F.sum("v").alias("v"), best.alias("t")).where(F.col("n") >= min_awarded)
    shown = counted.select(
        "name",
        F.col("n").alias("project_count"),
        F.col("t.winner").alias("top_winner"),
        F.col("t.n").alias("top_winner_projects"),
        F.round("v", 2).cast("double").alias("awarded_sum_eur"),
        pct(F.col("t.n"), F.col("n")).alias("top_winner_share_pct"),
    )
    return top(shown, k, F.desc("top_winner_share_pct"), F.desc("project_count"), F.asc("name"))
