"""Purchaser view: what one buyer buys, from whom, and how open it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.cleaning import decision_lag, mean, pct
from ..functions.names import display_name
from ..operators.facts import COUNT, WINNER, amount, estimate, filled, has_winner, total
from ..operators.ranking import common_values, top, top_lists


def options(rows: DataFrame) -> DataFrame:
    return rows.where(filled("purchaser_name")).select(F.col("purchaser_name").alias("name")).distinct().orderBy("name")


def chosen_rows(rows: DataFrame, purchaser: str | None) -> DataFrame:
    """Rows of the purchaser; of the first one by name when none is given."""
    if purchaser:
        return rows.where(F.col("purchaser_name") == purchaser)
    first = options(rows).agg(F.min("name").alias("purchaser_name"))
    return rows.join(F.broadcast(first), "purchaser_name", "left_semi")


def purchaser_rows(rows: DataFrame, bids: DataFrame, purchaser: str | None = None) -> DataFrame:
    """The purchaser's rows with bidder counts from the lists, else the stored count."""
    mine = chosen_rows(rows, purchaser)
    listed = (
        bids.join(mine.select("procurement_id"), "procurement_id", "left_semi")
        .groupBy("procurement_id")
        .agg(F.count(F.lit(1)).alias("listed"))
    )
    return mine.join(listed, "procurement_id", "left").withColumns(
        {
            "bidders": F.coalesce("listed", F.col(COUNT).cast("long")),
            "supplier": F.when(has_winner(), display_name(F.col(WINNER))),
            "lag": decision_lag(F.col("bid_deadline"), F.col("decision_date")),
            "region": F.coalesce(F.nullif(F.col("planning_region"), F.lit("")), F.lit(fixed.NO_REGION)),
            "category": F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(fixed.NO_CATEGORY)),
            "cpv": F.coalesce(F.nullif(F.col("cpv_main"), F.lit("")), F.lit(fixed.NO_PARTY)),
        }
    )


def suppliers(mine: DataFrame, k: int | None = 10) -> DataFrame:
    """Winners with projects, value and share of the purchaser's projects."""
    counted = mine.groupBy("supplier").agg(F.count(F.lit(1)).alias("project_count"), total(amount()).alias("awarded_sum_eur"))
    every = mine.agg(F.count(F.lit(1)).alias("n")).scalar()
    shown = counted.where(F.col("supplier").isNotNull()).select(
        F.col("supplier").alias("name"), "project_count", "awarded_sum_eur", pct(F.col("project_count"), every).alias("win_share_pct")
    )
    return top(shown, k, F.desc("awarded_sum_eur"), F.desc("project_count"), F.asc("name"))


def summary(mine: DataFrame) -> DataFrame:
    """Totals over the purchaser's rows; the top supplier is the first by value."""
    n, known = F.count(F.lit(1)), F.count("bidders")
    first = suppliers(mine, 1).agg(F.max("project_count").alias("n")).scalar()
    totals = mine.agg(
        n.alias("projects"),
        total(amount()).alias("awarded_sum_eur"),
        total(estimate()).alias("estimated_sum_eur"),
        F.countDistinct("supplier").alias("suppliers_count"),
        mean(F.sum("bidders"), known).alias("avg_competitors"),
        pct(F.count_if(F.col("bidders") == 1), known).alias("single_bidder_share_pct"),
        mean(F.sum("lag"), F.count("lag"), 1).alias("avg_decision_lag_days"),
    )
    return totals.withColumn("top_supplier_share_pct", pct(first, F.col("projects")))


def fit(mine: DataFrame, k: int = 10) -> DataFrame:
    used = mine.withColumn("method", F.nullif(F.col("evaluation_method"), F.lit("")))
    return common_values(used, {"category": "category", "region": "region", "cpv": "cpv", "year": "year", "evaluation_method": "method"}, k)


def frequent_bidders(mine: DataFrame, bids: DataFrame, k: int = 10) -> DataFrame:
    """Bidders by appearances, repeats in one list counted, with their wins here."""
    shown = bids.join(mine.select("procurement_id"), "procurement_id", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("project_count"))
    won = suppliers(mine, None).select("name", F.col("project_count").alias("win_count"), "awarded_sum_eur")
    joined = shown.join(won, "name", "left").select(
        "name",
        "project_count",
        F.coalesce("awarded_sum_eur", F.lit(0.0)).alias("awarded_sum_eur"),
        F.coalesce("win_count", F.lit(0)).alias("win_count"),
    )
    rated = joined.withColumn("win_rate_pct", pct(F.col("win_count"), F.col("project_count")))
    return top(rated, k, F.desc("project_count"), F.desc("win_count"), F.asc("name"))


def segments(mine: DataFrame) -> DataFrame:
    """Projects per (category, region, code); bidder figures divide by all of them."""
    n, listed = F.count(F.lit(1)), F.coalesce("listed", F.lit(0))
    return mine.groupBy("category", "region", "cpv").agg(
        n.alias("projects"),
        total(amount()).alias("awarded_sum_eur"),
        mean(F.sum(listed), n).alias("avg_competitors"),
        pct(F.count_if(F.col("listed") == 1), n).alias("single_bidder_share_pct"),
    )


def segment_rankings(table: DataFrame, k: int = 10) -> DataFrame:
    """Biggest segments, and open ones with two projects or more."""
    lists = {
        "biggest": (None, (-F.col("awarded_sum_eur"), -F.col("projects"))),
        "open": (F.col("projects") >= 2, (F.col("single_bidder_share_pct"), F.col("avg_competitors"), -F.col("projects"))),
    }
    return top_lists(table, k, lists, ("category", "region", "cpv"))


def dominant(mine: DataFrame) -> DataFrame:
    """The purchaser, its most common region and category, by name on ties."""
    best = common_values(mine, {"region": "region", "category": "category"}, 1)
    return best.agg(
        F.max(F.when(F.col("label") == "region", F.col("name"))).alias("dominant_region"),
        F.max(F.when(F.col("label") == "category", F.col("name"))).alias("dominant_category"),
    )


def market_context(rows: DataFrame, mine: DataFrame, k: int = 10) -> DataFrame:
    """Top purchasers and companies in the dominant region and category.

    Each row spreads to its region and category cells; the join with the two
    dominant values is a broadcast of two rows.
    """
    from pyspark.sql import Window

    region = F.coalesce(F.nullif(F.col("planning_region"), F.lit("")), F.lit(fixed.NO_REGION))
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(fixed.NO_CATEGORY))
    buyer = F.coalesce(F.nullif(F.col("purchaser_name"), F.lit("")), F.lit(fixed.NO_PARTY))
    wanted = common_values(mine, {"region": "region", "category": "category"}, 1).select(
        F.col("label").alias("scope"), F.col("name").alias("value")
    )
    cells = F.array(
        F.struct(F.lit("region").alias("scope"), region.alias("value")), F.struct(F.lit("category").alias("scope"), category.alias("value"))
    )
    sides = F.array(
        F.struct(F.lit("purchasers").alias("side"), buyer.alias("name")),
        F.struct(F.lit("companies").alias("side"), F.when(has_winner(), display_name(F.col(WINNER))).alias("name")),
    )
    spread = (
        rows.select(F.explode(cells).alias("c"), sides.alias("sides"), amount().alias("a"))
        .select("c.scope", "c.value", "sides", "a")
        .join(F.broadcast(wanted), ["scope", "value"])
        .select("scope", "value", F.explode("sides").alias("s"), "a")
        .select("scope", "value", "s.side", "s.name", "a")
        .where(F.col("name").isNotNull())
    )
    selected = mine.agg(F.max("purchaser_name").alias("n")).scalar()
    summed = spread.groupBy("scope", "value", "side", "name").agg(total(F.col("a")).alias("awarded_sum_eur"))
    order = Window.partitionBy("scope", "side").orderBy(F.desc("awarded_sum_eur"), F.asc("name"))
    best = summed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
    return best.withColumn("is_selected", (F.col("side") == "purchasers") & (F.col("name") == selected))
