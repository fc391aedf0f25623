"""Bidder profiles: one vector per bidder, the shares of its participations by classification division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import compared_party_name

# Divisions are the first two digits of a classification code.
DIVISIONS = 99


def bidder_profiles(participants: DataFrame, announcements: DataFrame) -> DataFrame:
    """``bidder, profile`` from the landed participant and announcement tables.

    ``participants``: ``procurement_id, participant_name``; ``announcements``:
    ``procurement_id, cpv_main``. ``profile`` has ``DIVISIONS`` shares that sum to 1.
    Participations without a name or a division are left out, and so are bidders
    that have no others. A repeated row counts once.
    """
    division = F.substring("cpv_main", 1, 2).try_cast("int")
    coded = announcements.select("procurement_id", division.alias("division")).where(F.col("division").between(1, DIVISIONS)).distinct()
    named = participants.select("procurement_id", compared_party_name(F.col("participant_name")).alias("bidder")).where(F.col("bidder").isNotNull()).distinct()
    cells = named.join(coded, "procurement_id").groupBy("bidder", "division").agg(F.count(F.lit(1)).alias("n"))
    listed = cells.groupBy("bidder").agg(F.map_from_entries(F.collect_list(F.struct("division", "n"))).alias("counts"), F.sum("n").alias("total"))
    share = F.transform(F.sequence(F.lit(1), F.lit(DIVISIONS)), lambda i: F.coalesce(F.try_element_at("counts", i), F.lit(0)) / F.col("total"))
    return listed.select("bidder", share.alias("profile"))


def whole(profile: Column) -> Column:
    """Whether a profile is there and all its entries are finite numbers."""
    odd = F.exists(profile, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(profile.isNotNull() & ~odd, F.lit(False))


def integers(profile: Column, scale: int, most: int) -> Column:
    """``floor(scale * x)`` of each entry as a long; entries beyond ``most`` are refused, as sums over them could not be exact."""
    refused = F.raise_error(F.lit(f"profile entries beyond {most / scale:g} are not supported")).cast("long")
    return F.transform(profile, lambda x: F.when(F.abs(x.cast("double") * scale) < most, F.floor(x.cast("double") * scale)).otherwise(refused))
