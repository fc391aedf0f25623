"""Company view: how one company, or several taken as one, fares in the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.cleaning import mean, pct, size_band
from ..functions.names import party_name
from ..operators.facts import AWARD, ESTIMATE, GAP, amount, distinct_bids, gap_pct, mean_gap, total
from ..operators.ranking import common_values, top, top_lists
from .dashboard import buyer_concentration


def options(bids: DataFrame) -> DataFrame:
    """Display names of all bidders in order, by their first spelling in each procurement."""
    return distinct_bids(bids).where(F.col("name") != fixed.NO_PARTY).select("name").distinct().orderBy("name")


def selection(spark: SparkSession, bids: DataFrame, companies: list[str] | None = None) -> DataFrame:
    """Chosen names with their grouping form; the first option when none is chosen."""
    chosen = [x for x in (companies or []) if x]
    if chosen:
        picked = spark.createDataFrame([(i, x) for i, x in enumerate(chosen)], "ord int, name string")
    else:
        picked = options(bids).agg(F.min("name").alias("name")).select(F.lit(0).alias("ord"), "name")
    return picked.select("ord", "name", party_name(F.col("name")).alias("norm_name"))


def company_rows(rows: DataFrame, bids: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows the selection bid on, with its price, outcome, rivals' count and gaps.

    The selection is a parameter list, so its join is a broadcast; everything
    else is keyed by procurement.
    """
    norms = F.broadcast(chosen.select("norm_name").distinct())
    ours = bids.join(norms, "norm_name", "left_semi").groupBy("procurement_id").agg(F.min("price").alias("our_price"))
    field = (
        bids.select("procurement_id", "price")
        .join(ours, "procurement_id")
        .groupBy("procurement_id")
        .agg(
            F.first("our_price").alias("our_price"),
            F.count(F.lit(1)).alias("bidders"),
            F.count("price").alias("priced"),
            F.min(F.when(F.col("price") > F.col("our_price"), F.col("price"))).alias("next_price"),
        )
    )
    flagged = F.broadcast(chosen.select(F.col("norm_name").alias("winner_normalized"), F.lit(True).alias("won")).distinct())
    joined = rows.join(field, "procurement_id").join(flagged, "winner_normalized", "left").withColumn("won", F.coalesce("won", F.lit(False)))
    losing = F.when(~F.col("won"), gap_pct(F.col("our_price"), F.col(AWARD)))
    margin = F.when(F.col("won") & (F.col("priced") >= 2), gap_pct(F.col("next_price"), F.col("our_price")))
    return joined.withColumns(
        {
            "losing_gap": F.when(losing >= 0, losing),
            "margin": margin,
            "size_band": size_band(F.col(ESTIMATE)),
            "buyer": F.coalesce(F.nullif(F.col("buyer_normalized"), F.lit("")), F.lit(fixed.NO_PARTY)),
            "category": F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(fixed.NO_CATEGORY)),
            "region": F.coalesce(F.nullif(F.col("planning_region"), F.lit("")), F.lit(fixed.NO_REGION)),
            "cpv": F.coalesce(F.nullif(F.col("cpv_main"), F.lit("")), F.lit(fixed.NO_PARTY)),
        }
    )


def summary(ours: DataFrame) -> DataFrame:
    n, won = F.count(F.lit(1)), F.col("won")
    return ours.agg(
        n.alias("applications"),
        F.count_if(won).alias("wins"),
        F.count_if(~won).alias("losses"),
        pct(F.count_if(won), n).alias("win_rate_pct"),
        total(F.when(won, amount())).alias("won_value_eur"),
        mean_gap(F.col("losing_gap")).alias("avg_losing_gap_pct"),
        mean_gap(F.col("margin")).alias("avg_winning_margin_pct"),
        F.count_if(F.col("losing_gap") <= 3).alias("close_losses_3pct"),
        F.countDistinct("buyer").alias("buyers_count"),
        F.countDistinct("category").alias("categories_count"),
    )


def fit(ours: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent buyers, categories, regions, codes and size bands."""
    return common_values(ours, {x: x for x in ("buyer", "category", "region", "cpv", "size_band")}, k)


def segments(ours: DataFrame, k: int = 10, min_bids: int = 2) -> DataFrame:
    n, won = F.count(F.lit(1)), F.count_if("won")
    counted = ours.groupBy("category", "region", "cpv").agg(
        n.alias("bids"),
        won.alias("wins"),
        pct(won, n).alias("win_rate_pct"),
        mean(F.sum(F.col("bidders") - 1), n).alias("avg_competitors"),
    )
    fewest = F.coalesce(F.nullif(F.col("avg_competitors"), F.lit(0.0)), F.lit(999.0))
    order = (F.desc("win_rate_pct"), fewest.asc(), F.desc("bids"), F.asc("category"), F.asc("region"), F.asc("cpv"))
    return top(counted.where(F.col("bids") >= min_bids), k, *order)


def rivals(ours: DataFrame, bids: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per rival display name: meetings, who beat whom, mean gap."""
    norms = F.broadcast(chosen.select("norm_name").distinct())
    context = ours.select("procurement_id", "won", "our_price", "winner_normalized", AWARD)
    met = bids.join(norms, "norm_name", "left_anti").join(context, "procurement_id")
    we, they = F.col("won"), ~F.col("won") & F.coalesce(F.col("norm_name") == F.col("winner_normalized"), F.lit(False))
    gap = F.when(we, gap_pct(F.col("price"), F.col("our_price"))).when(they, gap_pct(F.col("our_price"), F.col(AWARD)))
    return met.withColumn("gap", gap).groupBy("name").agg(
        F.count(F.lit(1)).alias("meet_count"),
        F.count_if(they).alias("beat_us"),
        F.count_if(we).alias("we_beat"),
        mean_gap(F.col("gap")).alias("avg_gap_pct"),
    )


def rival_rankings(table: DataFrame, k: int = 10) -> DataFrame:
    """The three top lists of rivals, one row per (list, rival)."""
    lists = {
        "met_most": (None, (-F.col("meet_count"),)),
        "beat_us": (None, (-F.col("beat_us"), -F.col("meet_count"))),
        "we_beat": (None, (-F.col("we_beat"), -F.col("meet_count"))),
    }
    return top_lists(table, k, lists, ("name",))


def buyers(ours: DataFrame, rows: DataFrame) -> DataFrame:
    """Our record per buyer with the buyer's concentration in the whole market."""
    n, won = F.count(F.lit(1)), F.col("won")
    mine = ours.groupBy("buyer").agg(
        n.alias("bids"),
        F.count_if(won).alias("wins"),
        pct(F.count_if(won), n).alias("win_rate_pct"),
        total(F.when(won, amount())).alias("won_value_eur"),
    )
    market = buyer_concentration(rows, None, winner="winner_normalized").select(
        F.col("name").alias("buyer"), F.col("top_winner_share_pct").alias("market_concentration_pct")
    )
    return mine.join(market, "buyer", "left").withColumnRenamed("buyer", "name")


def buyer_rankings(table: DataFrame, k: int = 10, min_bids: int = 2) -> DataFrame:
    """Best buyers by win rate and target buyers by low concentration."""
    enough = F.col("bids") >= min_bids
    loose = F.coalesce("market_concentration_pct", F.lit(999.0))
    lists = {
        "best": (enough, (-F.col("win_rate_pct"), -F.col("wins"))),
        "targets": (enough, (loose, -F.col("bids"))),
    }
    return top_lists(table, k, lists, ("name",))


def label(bids: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen names, then the other spellings met in rows, joined by a dot."""
    met = bids.join(F.broadcast(chosen.select("norm_name").distinct()), "norm_name", "left_semi").select("name").distinct()
    given = chosen.select("ord", "name")
    extra = met.join(F.broadcast(given), "name", "left_anti").select(F.lit(2**31 - 1).alias("ord"), "name")
    every = given.unionByName(extra).groupBy("name").agg(F.min("ord").alias("ord"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "name")))
    return every.agg(F.array_join(F.transform(parts, lambda p: p["name"]), " · ").alias("selected_company"))
