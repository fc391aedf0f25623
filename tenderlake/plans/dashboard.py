"""Market dashboard: totals, rankings, concentration, bidders, lots, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, jsonlists
from ..functions.cleaning import mean, pct
from ..operators.facts import (
    AWARD, COUNT, ESTIMATE, WINNER, amount, bid_facts, estimate, filled, has_winner, total,
)
from ..operators.ranking import most_common, top
from ..session import written

RANKED = {
    "winner": "winner_display_name",
    "buyer": "buyer_normalized",
    "region": "planning_region",
    "category": "category",
    "cpv": "cpv_main",
}
RANK_SIZE = {"winner": 10, "buyer": 10, "region": 10, "category": None, "cpv": 15}


def _one() -> Column:
    return F.count(F.lit(1))


def _default(name: str, placeholder: str) -> Column:
    return F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit(placeholder))


def _buyer() -> Column:
    return _default("buyer_normalized", fixed.NO_PARTY)


def _category() -> Column:
    return _default("category", fixed.NO_CATEGORY)


def overview(rows: DataFrame) -> DataFrame:
    single = F.count_if(F.col(COUNT) == 1)
    multi = F.count_if("is_multi_lot")
    bidders = F.sum(F.coalesce(F.col(COUNT), F.lit(0)))
    return rows.agg(
        _one().alias("projects_in_scope"),
        total(amount()).alias("total_awarded_sum_eur"),
        total(estimate()).alias("total_estimated_sum_eur"),
        F.count(AWARD).alias("awarded_projects_count"),
        F.count(ESTIMATE).alias("estimated_projects_count"),
        F.countDistinct(F.when(has_winner(), F.col("winner_display_name"))).alias("winners_count"),
        multi.alias("multi_lot_projects_count"),
        pct(multi, _one()).alias("multi_lot_share_pct"),
        mean(bidders, _one()).alias("average_bidders"),
        pct(single, _one()).alias("single_bidder_share_pct"),
        F.countDistinct(_buyer()).alias("buyers_count"),
        F.countDistinct("planning_region").alias("regions_count"),
    )


def yearly_series(rows: DataFrame) -> DataFrame:
    multi = F.count_if("is_multi_lot")
    return (
        rows.where(F.col("year").isNotNull())
        .groupBy("year")
        .agg(
            _one().alias("projects"),
            total(amount()).alias("awarded_sum_eur"),
            total(estimate()).alias("estimated_sum_eur"),
            multi.alias("multi_lot_projects"),
            pct(multi, _one()).alias("multi_lot_share_pct"),
        )
        .orderBy("year")
    )


def ranking(rows: DataFrame, dimension: str, k: int | None = -1) -> DataFrame:
    """Count and awarded sum per winner, buyer, region, category or code."""
    placeholder = {"category": fixed.NO_CATEGORY, "region": fixed.NO_REGION}.get(dimension, fixed.NO_PARTY)
    if dimension == "winner":
        rows = rows.where(has_winner())
    k = RANK_SIZE[dimension] if k == -1 else k
    counted = rows.groupBy(_default(RANKED[dimension], placeholder).alias("name")).agg(
        _one().alias("project_count"), total(amount()).alias("awarded_sum_eur")
    )
    return top(counted, k, F.desc("awarded_sum_eur"), F.desc("project_count"), F.asc("name"))


def category_summary(rows: DataFrame) -> DataFrame:
    c = _category()
    group = (
        F.when(c == "design", "design").when(c == "design_build", "design_build").when(c.isin(*fixed.BUILD_CATEGORIES), "build")
    )
    return _grouped_summary(rows, group, ("design", "build", "design_build"))


def _grouped_summary(rows: DataFrame, group: Column, names: tuple[str, ...]) -> DataFrame:
    """Fixed groups as rows, also those that no row falls in."""
    flagged = rows.select(group.alias("g"), amount().alias("a"))
    sums = flagged.agg(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("name"),
                    F.count_if(F.col("g") == n).alias("project_count"),
                    total(F.when(F.col("g") == n, F.col("a"))).alias("awarded_sum_eur"),
                )
                for n in names
            ]
        ).alias("groups")
    )
    return sums.select(F.inline("groups"))


def concentration(rows: DataFrame) -> DataFrame:
    """Share of the five best-paid winners and the squared-share index."""
    paid = rows.where(has_winner()).groupBy("winner_display_name").agg(F.sum(amount()).alias("won"))
    positive = F.when(F.col("won") > 0, F.col("won").cast("double"))
    best = top(paid, 5, F.desc("won"), F.asc("winner_display_name")).agg(F.sum("won").cast("double").alias("v"))
    every = rows.agg(F.sum(amount()).cast("double").alias("v"))
    squares = paid.agg(F.sum(positive * positive).alias("squares"))
    grand = F.col("grand")
    return squares.select("squares", best.scalar().alias("best"), every.scalar().alias("grand")).select(
        pct(F.col("best"), grand).alias("top5_awarded_share_pct"),
        F.round(F.try_divide(F.col("squares") * 10000.0, grand * grand), 1).alias("hhi"),
    )


def _shown_names(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Display name per bidder: its spelling on the newest row, newest year and greatest id first.

    Nearly every bidder has one spelling, which the cells tell already; only
    the facts of bidders with several are looked at again.
    """
    spellings = cells.groupBy("norm_name", "name").agg(_one().alias("n"))
    per_bidder = spellings.groupBy("norm_name").agg(_one().alias("spellings"), F.min("name").alias("name"))
    several = per_bidder.where(F.col("spellings") > 1).select("norm_name")
    single = per_bidder.where(F.col("spellings") == 1).select("norm_name", "name")
    newest = F.max(F.struct("year", "procurement_id", "name")).getField("name").alias("name")
    return single.unionByName(facts.join(several, "norm_name", "left_semi").groupBy("norm_name").agg(newest))


def bidder_table(rows: DataFrame, bids: DataFrame) -> DataFrame:
    """Every bidder with applications, outcomes, values, gaps and top category.

    The bid facts are written once and read three times, each time by an
    aggregation of fixed-width measures, which hashes instead of sorting: small
    (bidder, spelling, category) cells for totals, top category and display
    name, and distinct buyers.
    """
    gap, won, lost = F.col("gap"), F.col("won"), ~F.col("won")
    facts = written(
        bid_facts(rows, bids).select(
            "norm_name", "name", "year", "procurement_id", _buyer().alias("buyer"), _category().alias("category"), "price", "won", AWARD, "gap"
        )
    )
    cells = (
        facts.groupBy("norm_name", "name", "category").agg(
            _one().alias("applications"),
            F.count_if(won).alias("wins"),
            F.count_if(lost).alias("losses"),
            F.sum("price").alias("bid_value"),
            F.sum(F.when(won, F.col(AWARD))).alias("won_value"),
            *[F.count_if(gap <= n).alias(f"close_losses_{n}pct") for n in (1, 3, 5)],
            F.sum(gap.cast("decimal(24,6)")).alias("gap_sum"),
            F.count(gap).alias("gap_count"),
        )
    )
    favourite = most_common(cells, ["norm_name"], "category", F.sum("applications"), "top_category")
    totals = cells.groupBy("norm_name").agg(
        F.sum("applications").alias("applications"),
        F.sum("wins").alias("wins"),
        F.sum("losses").alias("losses"),
        pct(F.sum("wins"), F.sum("applications")).alias("win_rate_pct"),
        total(F.col("bid_value")).alias("total_bid_value_eur"),
        total(F.col("won_value")).alias("won_value_eur"),
        *[F.sum(f"close_losses_{n}pct").alias(f"close_losses_{n}pct") for n in (1, 3, 5)],
        mean(F.sum("gap_sum"), F.sum("gap_count")).alias("avg_loss_gap_pct"),
    )
    buyers = facts.select("norm_name", "buyer").distinct().groupBy("norm_name").agg(_one().alias("buyers_count"))
    return (
        totals.join(buyers, "norm_name")
        .join(_shown_names(cells, facts), "norm_name")
        .join(favourite.drop("top_category_count"), "norm_name", "left")
        .drop("norm_name")
    )


def bidder_leaderboard(bidders: DataFrame, k: int | None = 15) -> DataFrame:
    return top(bidders, k, F.desc("applications"), F.desc("wins"), F.asc("name"))


def bidder_losers(bidders: DataFrame, k: int = 10, min_applications: int = 5) -> DataFrame:
    return bidder_leaderboard(bidders.where((F.col("wins") == 0) & (F.col("applications") >= min_applications)), k)


def bidder_winners_by_rate(bidders: DataFrame, k: int = 10, min_wins: int = 3) -> DataFrame:
    order = (F.desc("win_rate_pct"), F.desc("wins"), F.desc("won_value_eur"), F.asc("name"))
    return top(bidders.where(F.col("wins") >= min_wins), k, *order)


def bidder_winners_by_value(bidders: DataFrame, k: int = 10) -> DataFrame:
    order = (F.desc("won_value_eur"), F.desc("wins"), F.desc("win_rate_pct"), F.asc("name"))
    return top(bidders.where(F.col("wins") >= 1), k, *order)


def close_losses(bidders: DataFrame, k: int = 10) -> DataFrame:
    gap = F.coalesce(F.nullif(F.col("avg_loss_gap_pct"), F.lit(0.0)), F.lit(9999.0))
    order = (F.desc("close_losses_3pct"), F.desc("applications"), gap.asc(), F.asc("name"))
    return top(bidders.where(F.col("close_losses_3pct") > 0), k, *order)


def buyer_concentration(rows: DataFrame, k: int | None = 10, min_awarded: int = 5, winner: str = "winner_display_name") -> DataFrame:
    """Per buyer the most frequent winner with its share of awards and of value."""
    cells = (
        rows.where(has_winner())
        .groupBy(_buyer().alias("name"), F.col(winner).alias("winner"))
        .agg(_one().alias("n"), F.sum(amount()).alias("v"))
    )
    first = F.min_by(F.struct("winner", "n", "v"), F.struct(-F.col("n"), F.col("winner")))
    buyers = cells.groupBy("name").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), first.alias("t")).where(F.col("n") >= min_awarded)
    shown = buyers.select(
        "name",
        F.col("n").alias("project_count"),
        F.col("v").cast("double").alias("awarded_sum_eur"),
        F.col("t.winner").alias("top_winner"),
        F.col("t.n").alias("top_winner_projects"),
        pct(F.col("t.n"), F.col("n")).alias("top_winner_share_pct"),
        pct(F.col("t.v"), F.col("v")).alias("top_winner_amount_share_pct"),
    )
    return top(shown, k, F.desc("top_winner_share_pct"), F.desc("project_count"), F.asc("name"))


def multi_lot(rows: DataFrame) -> DataFrame:
    """Lots of multi-lot procurements: the stored count, else the JSON list length, else 0."""
    lots = F.coalesce(F.col("lot_count").cast("int"), jsonlists.list_length(F.col("lots_json")), F.lit(0))
    many = F.count_if("is_multi_lot")
    known = F.coalesce(F.sum(F.when(F.col("is_multi_lot"), lots)), F.lit(0))
    return rows.agg(
        many.alias("projects"),
        pct(many, _one()).alias("share_pct"),
        known.cast("long").alias("known_total_lots"),
        mean(known, many).alias("average_lots_per_multi_lot_project"),
    )


def data_quality(rows: DataFrame) -> DataFrame:
    """Missing count and coverage of eight fields."""
    missing = {
        "winner": ~filled(WINNER),
        "award_amount": F.col(AWARD).isNull(),
        "estimated_value": F.col(ESTIMATE).isNull(),
        "delivery_location": ~filled("delivery_location"),
        "bid_deadline": ~filled("bid_deadline"),
        "decision_date": ~filled("decision_date"),
        "participants": F.col(COUNT).isNull(),
        "eu_project_reference": ~filled("eu_project_reference"),
    }
    counted = rows.agg(_one().alias("n"), *[F.count_if(x).alias(name) for name, x in missing.items()])
    items = [F.struct(F.lit(n).alias("field"), F.lit(fixed.QUALITY_LABELS[n]).alias("label"), F.col(n).alias("missing_count")) for n in missing]
    return counted.select("n", F.inline(F.array(*items))).select(
        "field", "label", "missing_count", F.round(100.0 - F.try_divide(F.col("missing_count") * 100.0, F.col("n").cast("double")), 1).alias("coverage_pct")
    )


PROJECT_COLUMNS = (
    "procurement_id", "year", "procurement_name", "purchaser_name", "planning_region", "category", "cpv_main",
    "cpv_additional", "location_bucket", "procurement_status", WINNER, AWARD, ESTIMATE, COUNT, "is_multi_lot", "lot_count",
)
PROJECT_NAMES = {WINNER: "winner", AWARD: "awarded_sum_eur", ESTIMATE: "estimated_sum_eur", COUNT: "participants_count"}


def project_page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of projects, newest year first, ids compared as text.

    Every row also carries the page's ``limit`` and ``offset``. A limit outside
    1..200 or a negative offset is refused, as the listing does.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie in 1..200")
    if offset < 0:
        raise ValueError("offset must not be negative")
    shown = rows.select(*[F.col(x).alias(PROJECT_NAMES.get(x, x)) for x in PROJECT_COLUMNS if x in rows.columns])
    ordered = shown.orderBy(F.desc("year"), F.desc("procurement_id"))
    return ordered.offset(offset).limit(limit).withColumns({"limit": F.lit(limit), "offset": F.lit(offset)})


def project_total(rows: DataFrame) -> DataFrame:
    """Number of projects that the pages of ``rows`` hold together: one row, ``total``."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def available_filters(rows: DataFrame) -> DataFrame:
    """Distinct filter values as (kind, value) rows."""
    kinds = {"year": "year", "buyer": "purchaser_name", "planning_region": "planning_region", "category": "category"}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(v).cast("string").alias("value")) for k, v in kinds.items()])
    listed = rows.select(F.explode(pairs).alias("p")).select("p.kind", "p.value").where(filled("value"))
    return listed.distinct().orderBy("kind", "value")


def portal_filters(announcements: DataFrame) -> DataFrame:
    """Filter values of the announcement table: deadline years, buyers, regions met, every known category."""
    from ..functions.cleaning import deadline_date
    from ..functions.labels import planning_region

    region = F.when(filled("region"), planning_region(F.col("region")))
    pairs = F.array(
        F.struct(F.lit("year").alias("kind"), F.year(deadline_date(F.col("submission_deadline"))).cast("string").alias("value")),
        F.struct(F.lit("buyer").alias("kind"), F.col("buyer").alias("value")),
        F.struct(F.lit("planning_region").alias("kind"), region.alias("value")),
    )
    met = announcements.select(F.explode(pairs).alias("p")).select("p.kind", "p.value").where(F.col("value").isNotNull()).distinct()
    names = sorted(set(fixed.CPV_LABELS.values()))
    known = announcements.sparkSession.createDataFrame([("category", x) for x in names], "kind string, value string")
    return met.unionByName(known).orderBy("kind", "value")
