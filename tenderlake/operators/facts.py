"""Enriched procurement rows, bids and bid facts shared by the views.

Row frames hold one row per procurement (``procurement_id``); bid frames hold
``procurement_id, pos, name, norm_name, reg, price`` with ``pos`` the list order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as c
from ..functions import fixed, jsonlists, labels, names

AWARD = "procurement_winner_suggested_price_eur"
ESTIMATE = "estimated_value_eur"
COUNT = "procurement_participants_count"
WINNER = "procurement_winner"
GAP = "decimal(24,6)"


@dataclass(frozen=True)
class Filters:
    """Row filters; ``None`` leaves a dimension open."""

    year: int | None = None
    planning_region: str | None = None
    multi_lot: bool | None = None
    buyer: str | None = None
    category: str | None = None


def apply_filters(rows: DataFrame, filters: Filters = Filters()) -> DataFrame:
    if filters.year is not None:
        rows = rows.where(F.col("year") == filters.year)
    if filters.multi_lot is not None:
        rows = rows.where(F.coalesce("is_multi_lot", F.lit(False)) == F.lit(filters.multi_lot))
    if filters.buyer:
        rows = rows.where(F.col("purchaser_name") == filters.buyer)
    if filters.planning_region:
        rows = rows.where(F.col("planning_region") == filters.planning_region)
    if filters.category:
        rows = rows.where(F.col("category") == filters.category)
    return rows


def report_scope(records: DataFrame, pattern: str = fixed.REPORT_SCOPE) -> DataFrame:
    return records.where(F.ilike(F.col("report_document_path"), F.lit(pattern)))


def awarded_scope(records: DataFrame, multi_lot: bool | None = None) -> DataFrame:
    """Announcements in a decided status; lot flag is the text ``Jā`` or not."""
    scoped = records.where(F.col("status").isin(*fixed.AWARDED_STATUSES))
    if multi_lot is None:
        return scoped
    has = F.col("has_lots").eqNullSafe(fixed.YES_LV)
    return scoped.where(has if multi_lot else ~has)


def enrich(records: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Typed and derived columns; the canonical company name wins when known."""
    rows = records.withColumns(
        {
            ESTIMATE: F.col(ESTIMATE).try_cast(c.MONEY),
            AWARD: F.col(AWARD).try_cast(c.MONEY),
            COUNT: F.col(COUNT).try_cast("int"),
            "lot_count": F.col("lot_count").try_cast("int"),
            "is_multi_lot": F.coalesce(F.col("is_multi_lot").try_cast("boolean"), F.lit(False)),
            "location_bucket": labels.location_bucket(F.col("delivery_location")),
            "planning_region": labels.planning_region(F.col("delivery_location")),
            "buyer_normalized": names.party_name(F.coalesce("purchaser_name", F.lit(""))),
            "winner_normalized": names.party_name(F.coalesce(WINNER, F.lit(""))),
            "category": labels.category(F.col("contract_scope_type")),
        }
    )
    if companies is None:
        return rows.withColumn("winner_display_name", F.col("winner_normalized"))
    known = companies.select(F.col("id").alias("winner_company_id"), "canonical_name")
    return (
        rows.join(known, "winner_company_id", "left")
        .withColumn("winner_display_name", F.coalesce("canonical_name", "winner_normalized"))
        .drop("canonical_name")
    )


def portal_rows(announcements: DataFrame, results: DataFrame, participants: DataFrame) -> DataFrame:
    """Market rows from the relational tables: best result and bidder count attached."""
    from .views import participant_counts, top_result

    best = top_result(results)
    counted = participant_counts(participants)
    deadline = F.col("submission_deadline")
    joined = announcements.join(best, "procurement_id", "left").join(counted, "procurement_id", "left")
    return joined.select(
        "procurement_id",
        F.year(c.deadline_date(deadline)).alias("year"),
        "cpv_main",
        F.col("buyer").alias("purchaser_name"),
        F.col("region").alias("delivery_location"),
        F.col(ESTIMATE).try_cast(c.MONEY).alias(ESTIMATE),
        F.col("title").alias("procurement_name"),
        F.col("status").alias("procurement_status"),
        deadline.alias("bid_deadline"),
        F.col("winner_selection_method").alias("evaluation_method"),
        "eu_project_reference",
        F.col("has_lots").eqNullSafe(fixed.YES_LV).alias("is_multi_lot"),
        F.col("winner_name").alias(WINNER),
        F.col("winner_reg_number").alias("procurement_winner_registration_no"),
        F.col("contract_value_eur").try_cast(c.MONEY).alias(AWARD),
        F.col("contract_signed_date").alias("decision_date"),
        F.coalesce("participant_count", F.lit(0)).cast("int").alias(COUNT),
        labels.location_bucket(F.col("region")).alias("location_bucket"),
        labels.planning_region(F.col("region")).alias("planning_region"),
        names.party_name(F.coalesce("buyer", F.lit(""))).alias("buyer_normalized"),
        names.party_name(F.coalesce("winner_name", F.lit(""))).alias("winner_normalized"),
        names.party_name(F.coalesce("winner_name", F.lit(""))).alias("winner_display_name"),
        labels.cpv_category(F.col("cpv_main")).alias("category"),
    )


def bids_from_json(rows: DataFrame) -> DataFrame:
    """Bids of the participant lists held as JSON text, parsed once."""
    # Outer, since an inner explode would parse every list once more to drop the empty ones.
    parsed = jsonlists.participants(F.col("procurement_participants_json"))
    listed = rows.select("procurement_id", F.posexplode_outer(parsed).alias("pos", "p")).where(F.col("pos").isNotNull())
    return listed.select(
        "procurement_id",
        F.col("pos").cast("long").alias("pos"),
        names.display_name(F.col("p.name")).alias("name"),
        names.party_name(F.coalesce("p.name", F.lit(""))).alias("norm_name"),
        F.col("p.reg").alias("reg"),
        F.col("p.price").alias("price"),
    )


def bids_from_participants(participants: DataFrame) -> DataFrame:
    """Bids of the participant table, which carries no prices."""
    name = F.col("participant_name")
    return participants.select(
        "procurement_id",
        F.xxhash64("participant_reg_number", "participant_name").alias("pos"),
        names.display_name(name).alias("name"),
        names.party_name(F.coalesce(name, F.lit(""))).alias("norm_name"),
        F.col("participant_reg_number").alias("reg"),
        F.lit(None).cast(c.MONEY).alias("price"),
    )


def amount() -> Column:
    return F.coalesce(F.col(AWARD), F.lit(0).cast(c.MONEY))


def estimate() -> Column:
    return F.coalesce(F.col(ESTIMATE), F.lit(0).cast(c.MONEY))


def has_winner() -> Column:
    return F.coalesce(F.col(WINNER) != "", F.lit(False))


def filled(name: str) -> Column:
    """Text column that is neither null nor empty."""
    return F.coalesce(F.col(name) != "", F.lit(False))


def total(x: Column) -> Column:
    """Exact decimal sum as a double."""
    return F.round(F.coalesce(F.sum(x), F.lit(0)), 2).cast("double")


def gap_pct(price: Column, base: Column) -> Column:
    """Percent by which ``price`` exceeds ``base``; null without a usable base."""
    usable = price.isNotNull() & base.isNotNull() & (base != 0)
    p, b = price.cast("double"), base.cast("double")
    return F.when(usable, (p - b) / b * 100.0)


def mean_gap(gap: Column) -> Column:
    """Mean of gaps through an exact sum, so that task order cannot change it."""
    exact = gap.cast(GAP)
    return F.round(F.try_divide(F.sum(exact).cast("double"), F.count(exact).cast("double")), 2)


def distinct_bids(bids: DataFrame) -> DataFrame:
    """First bid of each bidder per procurement; placeholder names dropped."""
    first = F.min_by(F.struct("name", "price"), F.col("pos"))
    return (
        bids.where(F.col("norm_name") != fixed.NO_PARTY)
        .groupBy("procurement_id", "norm_name")
        .agg(first.alias("first"))
        .select("procurement_id", "norm_name", "first.name", "first.price")
    )


def bid_facts(rows: DataFrame, bids: DataFrame) -> DataFrame:
    """Distinct bids with the row's buyer and category, the outcome and the losing gap."""
    context = rows.select("procurement_id", "year", "buyer_normalized", "category", "winner_normalized", AWARD)
    won = F.coalesce(F.col("norm_name") == F.col("winner_normalized"), F.lit(False))
    gap = F.when(~won, gap_pct(F.col("price"), F.col(AWARD)))
    return (
        distinct_bids(bids)
        .join(context, "procurement_id")
        .withColumns({"won": won, "gap": F.when(gap >= 0, gap)})
    )
