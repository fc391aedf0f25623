"""What a company did: participations, wins, statistics, code profile, name lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.cleaning import MONEY, guarded_date, none_if_blank
from ..functions.labels import cpv_label
from .ranking import top

SHOWN = ("procurement_id", "title", "buyer", "cpv_main", "submission_deadline", "estimated_value_eur", "eis_url", "status")
TEXTS = ("procurement_id", "title", "buyer", "cpv_main", "submission_deadline", "eis_url", "status")
PARTICIPANT = ("participant_name", "participant_reg_number")
WINNER = ("winner_name", "winner_reg_number")


def is_company(side: tuple[str, str], name: str, reg: str | None = None) -> Column:
    """Exact registration number when given, else the name contained."""
    return F.col(side[1]) == reg if reg else F.ilike(F.col(side[0]), F.lit(f"%{name}%"))


def short_name_match(column: str, query: str, whole_word: bool = False) -> Column:
    """Containment; names of four characters or fewer need a blank on both sides.

    ``whole_word`` also accepts a short name at either end.
    """
    name = query.strip()
    if len(name) > 4:
        return F.ilike(F.col(column), F.lit(f"%{name}%"))
    text = F.concat(F.lit(" "), F.col(column), F.lit(" ")) if whole_word else F.col(column)
    return F.ilike(text, F.lit(f"% {name} %"))


def _shape(df: DataFrame) -> DataFrame:
    texts = {x: F.coalesce(F.col(x), F.lit("")) for x in TEXTS}
    return df.withColumns({**texts, "signed_date": none_if_blank(F.col("signed_date"))})


def participations(announcements: DataFrame, participants: DataFrame, name: str, reg: str | None = None, k: int = 20) -> DataFrame:
    """Latest procurements the company bid on.

    Every shown column belongs to the announcement, so a semi join gives each
    procurement once without sorting its bidders.
    """
    mine = participants.where(is_company(PARTICIPANT, name, reg)).select("procurement_id")
    day = F.coalesce(guarded_date(none_if_blank(F.col("submission_deadline"))), guarded_date(none_if_blank(F.col("publication_date"))))
    met = announcements.join(mine, "procurement_id", "left_semi").withColumn("_day", day)
    best = top(met, k, F.desc_nulls_last("_day"), F.desc("procurement_id"))
    nothing = {"contract_value_eur": F.lit(None).cast("double"), "signed_date": F.lit(None).cast("string")}
    return _shape(best.select(*SHOWN).withColumns(nothing))


def wins(announcements: DataFrame, results: DataFrame, name: str, reg: str | None = None, k: int = 20) -> DataFrame:
    """Latest procurements the company won, one result each: the latest signed."""
    mine = results.where(is_company(WINNER, name, reg))
    signed = guarded_date(none_if_blank(F.col("contract_signed_date")))
    order = F.struct(signed.alias("d"), F.col("contract_value_eur").alias("v"), F.col("contract_signed_date").alias("t"))
    kept = F.struct(F.col("contract_value_eur"), F.col("contract_signed_date").alias("signed_date"), signed.alias("_day"))
    latest = mine.groupBy("procurement_id").agg(F.max_by(kept, order).alias("r")).select("procurement_id", "r.*")
    met = announcements.select(*SHOWN).join(latest, "procurement_id")
    best = top(met, k, F.desc_nulls_last("_day"), F.desc("procurement_id"))
    return _shape(best.drop("_day"))


def stats(participants: DataFrame, results: DataFrame, name: str, reg: str | None = None) -> DataFrame:
    """Distinct bids, wins and their union, value of all matching results, win rate."""
    bid = participants.where(is_company(PARTICIPANT, name, reg)).select(
        "procurement_id", F.lit(1).alias("bid"), F.lit(0).alias("won"), F.lit(None).cast(MONEY).alias("value")
    )
    won = results.where(is_company(WINNER, name, reg)).select(
        "procurement_id", F.lit(0).alias("bid"), F.lit(1).alias("won"), F.col("contract_value_eur").try_cast(MONEY).alias("value")
    )
    each = bid.unionByName(won).groupBy("procurement_id").agg(F.max("bid").alias("bid"), F.max("won").alias("won"), F.sum("value").alias("value"))
    n, w = F.count(F.lit(1)), F.coalesce(F.sum("won"), F.lit(0))
    return each.agg(
        n.alias("total_contracts"),
        F.coalesce(F.sum("bid"), F.lit(0)).alias("total_bids"),
        w.alias("total_wins"),
        F.coalesce(F.round(F.try_divide(w.cast("double"), n.cast("double")), 3), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.sum("value").cast("double"), F.lit(0.0)).alias("total_won_value_eur"),
    )


def code_profile(announcements: DataFrame, participants: DataFrame, results: DataFrame, name: str, reg: str | None = None, k: int = 5) -> DataFrame:
    """Two-digit codes the company works in; a win weighs three bids."""

    def hits(df: DataFrame, side: tuple[str, str], weight: int) -> DataFrame:
        match = F.col(side[1]) == reg if reg else short_name_match(side[0], name)
        return df.where(match).groupBy("procurement_id").agg((F.count(F.lit(1)) * weight).alias("w"))

    coded = announcements.where(F.coalesce(F.col("cpv_main") != "", F.lit(False))).select(
        "procurement_id", F.substring("cpv_main", 1, 2).alias("cpv_prefix")
    )
    weighed = hits(participants, PARTICIPANT, 1).unionByName(hits(results, WINNER, 3))
    counted = weighed.join(coded, "procurement_id").groupBy("cpv_prefix").agg(F.sum("w").alias("weight"))
    best = top(counted, k, F.desc("weight"), F.asc("cpv_prefix"))
    return best.withColumn("label", cpv_label(F.col("cpv_prefix"), fixed.SEARCH_CPV_LABELS))


def suggestions(participants: DataFrame, results: DataFrame, query: str, k: int = 8) -> DataFrame:
    """Most frequent (name, number) whose name contains the query; escaped cells left out."""

    def counted(df: DataFrame, side: tuple[str, str]) -> DataFrame:
        named = df.where(F.ilike(F.col(side[0]), F.lit(f"%{query.strip()}%")) & ~F.col(side[0]).startswith("="))
        return named.groupBy(F.col(side[0]).alias("name"), F.col(side[1]).alias("reg_number")).agg(F.count(F.lit(1)).alias("n"))

    both = counted(participants, PARTICIPANT).unionAll(counted(results, WINNER))
    if len(query.strip()) < 2:
        both = both.where(F.lit(False))
    summed = both.groupBy("name", "reg_number").agg(F.sum("n").alias("n"))
    best = top(summed, k, F.desc("n"), F.asc("name"), F.asc("reg_number"))
    return best.select("name", none_if_blank(F.col("reg_number")).alias("reg_number"))


def candidates(participants: DataFrame, results: DataFrame, query: str, k: int = 8) -> DataFrame:
    """Names matching the query with their wins and participations."""
    won = results.where(short_name_match("winner_name", query)).groupBy("winner_name").agg(F.count(F.lit(1)).alias("wins"))
    bid = participants.where(short_name_match("participant_name", query)).groupBy("participant_name").agg(F.count(F.lit(1)).alias("participations"))
    met = won.join(bid, F.lower("winner_name") == F.lower("participant_name"), "full")
    shown = met.select(
        F.coalesce("winner_name", "participant_name").alias("name"),
        F.coalesce("wins", F.lit(0)).alias("wins"),
        F.coalesce("participations", F.lit(0)).alias("participations"),
    )
    return top(shown, k, F.desc("wins"), F.desc("participations"), F.asc("name"))
