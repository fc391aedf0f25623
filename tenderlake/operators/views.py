"""Relational views over announcements, results and participants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANNOUNCED = ("procurement_id", "title", "buyer", "cpv_main", "status", "submission_deadline", "estimated_value_eur", "eis_url")


def winners_view(announcements: DataFrame, results: DataFrame) -> DataFrame:
    won = results.select(
        "procurement_id", "winner_name", "winner_reg_number", "contract_value_eur", "contract_signed_date",
        F.col("source_year").alias("result_year"),
    )
    return announcements.select(*ANNOUNCED).join(won, "procurement_id")


def participants_view(announcements: DataFrame, participants: DataFrame) -> DataFrame:
    bid = participants.select(
        "procurement_id", "participant_name", "participant_reg_number", "participant_submitted_at",
        F.col("source_year").alias("participant_year"),
    )
    return announcements.select(*ANNOUNCED).join(bid, "procurement_id")


def full_view(participants: DataFrame, results: DataFrame) -> DataFrame:
    """Participants with the matching result and a winner flag."""
    won = results.select(
        "procurement_id", "winner_name", "winner_reg_number", "contract_value_eur", "contract_signed_date",
        F.col("winner_reg_number").alias("participant_reg_number"),
    )
    joined = participants.join(won, ["procurement_id", "participant_reg_number"], "left")
    flag = F.col("participant_reg_number").isNotNull() & F.col("winner_reg_number").isNotNull()
    return joined.select(
        "procurement_id", F.col("procurement_title").alias("title"), "buyer", "cpv_main", "status", "submission_deadline",
        "estimated_value_eur", "participant_name", "participant_reg_number", "participant_submitted_at", "winner_name",
        "winner_reg_number", flag.alias("is_winner"), "contract_value_eur", "contract_signed_date",
    )


def org_activity(participants: DataFrame, results: DataFrame) -> DataFrame:
    """Per organisation: won, value, participated, first and last activity as text."""
    p = participants.select(
        F.col("procurement_id").alias("p_id"), "participant_reg_number", "participant_name", "submission_deadline"
    )
    r = results.select(
        F.col("procurement_id").alias("r_id"), "winner_reg_number", "winner_name", "contract_value_eur", "contract_signed_date"
    )
    both = (F.col("winner_reg_number") == F.col("participant_reg_number")) & (F.col("r_id") == F.col("p_id"))
    moment = F.coalesce("contract_signed_date", "submission_deadline")
    value = F.sum(F.col("contract_value_eur").try_cast("decimal(18,2)")).cast("double")
    return (
        p.join(r, both, "full")
        .groupBy(
            F.coalesce("winner_reg_number", "participant_reg_number").alias("reg_number"),
            F.coalesce("winner_name", "participant_name").alias("org_name"),
        )
        .agg(
            F.countDistinct("r_id").alias("procurements_won"),
            value.alias("total_won_eur"),
            F.countDistinct("p_id").alias("procurements_participated"),
            F.min(moment).alias("first_activity"),
            F.max(moment).alias("last_activity"),
        )
    )


def top_result(results: DataFrame) -> DataFrame:
    """Highest-value result per procurement; ties by winner name, then number."""
    value = F.col("contract_value_eur")
    order = F.struct(value.isNull(), -F.coalesce(value, F.lit(0.0)), F.col("winner_name").isNull(), "winner_name", "winner_reg_number")
    picked = F.struct("winner_name", "winner_reg_number", "contract_value_eur", "contract_signed_date")
    return results.groupBy("procurement_id").agg(F.min_by(picked, order).alias("r")).select("procurement_id", "r.*")


def participant_counts(participants: DataFrame) -> DataFrame:
    return participants.groupBy("procurement_id").agg(F.count(F.lit(1)).alias("participant_count"))


def with_top_result(announcements: DataFrame, results: DataFrame, participants: DataFrame) -> DataFrame:
    """Announcements with their best result and their bidder count, zero when none."""
    counted = participant_counts(participants)
    return (
        announcements.join(top_result(results), "procurement_id", "left")
        .join(counted, "procurement_id", "left")
        .withColumn("participant_count", F.coalesce("participant_count", F.lit(0)))
    )


def results_in_code_scope(results: DataFrame, raw_announcements: DataFrame, prefix: str) -> DataFrame:
    """Results of procurements whose raw, still escaped announcement has a code with the prefix."""
    from ..functions.cleaning import cpv_code, unwrap_loose

    wanted = raw_announcements.where(cpv_code(F.col("CPV_kods_galvenais_prieksmets")).startswith(prefix))
    ids = wanted.select(unwrap_loose(F.col("Iepirkuma_ID")).alias("procurement_id"))
    return results.join(ids, "procurement_id", "left_semi")


def member_lists(results: DataFrame, participants: DataFrame) -> DataFrame:
    """Ordered winner and participant lists per procurement, one row per member.

    Columns: ``procurement_id``, ``kind`` (winner or participant), ``position``
    from 1 in order of number, name and value (nulls first), the member's
    ``registration_no``, ``name`` and ``value_eur`` (null for participants), and
    the true ``winner_count`` and ``participant_count``. Members stay rows, so a
    procurement may have any number of them.
    """
    from pyspark.sql import Window

    won = results.select(
        "procurement_id", F.lit("winner").alias("kind"), F.col("winner_reg_number").alias("registration_no"), F.col("winner_name").alias("name"),
        F.col("contract_value_eur").alias("value_eur"),
    )
    bid = participants.select(
        "procurement_id", F.lit("participant").alias("kind"), F.col("participant_reg_number").alias("registration_no"),
        F.col("participant_name").alias("name"), F.lit(None).cast("double").alias("value_eur"),
    )
    members = won.unionByName(bid)
    totals = members.groupBy("procurement_id").agg(
        F.count_if(F.col("kind") == "winner").alias("winner_count"), F.count_if(F.col("kind") == "participant").alias("participant_count")
    )
    order = Window.partitionBy("procurement_id", "kind").orderBy("registration_no", "name", "value_eur")
    return members.withColumn("position", F.row_number().over(order)).join(totals, "procurement_id")

