"""Keyed merges with a rule per column.

Every rule is an associative aggregate over the rows of a key ordered by
``seq``, so a batch run and any split of it into increments give the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import none_if_blank

LAST = "last"
LAST_KNOWN = "last_known"
FIRST = "first"
FIRST_KNOWN = "first_known"
GREATEST = "greatest"

RESULT_KEYS = ("procurement_id", "winner_reg_number")
RESULT_RULES = {
    "contract_value_eur": GREATEST,
    "contract_value_original_eur": FIRST_KNOWN,
    "contract_signed_date": LAST_KNOWN,
    "source_year": LAST,
    "procurement_title": LAST_KNOWN,
    "buyer": FIRST,
    "buyer_reg_number": FIRST,
    "winner_name": FIRST,
}
PARTICIPANT_KEYS = ("procurement_id", "participant_reg_number")
PARTICIPANT_RULES = {
    "status": LAST,
    "participant_submitted_at": LAST_KNOWN,
    **dict.fromkeys(
        (
            "procurement_title", "identification_number", "buyer", "buyer_reg_number", "buyer_pvs_id", "parent_organization",
            "cpv_main", "subject_type", "estimated_value_eur", "currency", "contract_duration_months",
            "submission_deadline", "participant_name", "source_year",
        ),
        FIRST,
    ),
}
BUYER_KEYS = ("reg_number",)
BUYER_RULES = {
    "organization": LAST,
    "reg_number_type": LAST,
    "parent_organization": LAST,
    "is_blocked": LAST,
    "is_deleted": LAST,
    "registered_date": FIRST,
}
OUTCOME_COLUMNS = (
    "procurement_status_from_report", "procurement_winner", "procurement_winner_registration_no",
    "procurement_winner_suggested_price_eur", "procurement_winner_source", "procurement_participants_count",
    "procurement_participants_json", "procurement_outcome_description", "extracted_at", "bid_deadline", "decision_date",
    "funding_source", "eu_project_reference", "is_multi_lot", "lot_count", "lots_json", "evaluation_method",
    "contract_scope_type", "disqualified_participants_json", "subcontractors_json", "evaluation_criteria_json",
    "winner_company_id",
)
KEPT_IF_MISSING = ("procurement_participants_json", "disqualified_participants_json", "subcontractors_json", "lots_json")
CLASS_DEFAULTS = {
    "classification_domain": "unknown",
    "classification_scope_type": "unknown",
    "classification_work_type": "unknown",
    "classification_asset_scale": "unknown",
    "classification_final_category": "unknown",
    "classification_reason": "not_classified",
}


def _rule(rule: str, name: str, seq: Column) -> Column:
    x = F.col(name)
    known = F.when(x.isNotNull(), seq)
    return {
        LAST: lambda: F.max_by(x, seq),
        LAST_KNOWN: lambda: F.max_by(x, known),
        FIRST: lambda: F.min_by(x, seq),
        FIRST_KNOWN: lambda: F.min_by(x, known),
        GREATEST: lambda: F.max(x),
    }[rule]().alias(name)


def fold(rows: DataFrame, keys: tuple[str, ...], rules: dict[str, str], seq: str = "seq") -> DataFrame:
    """One row per key; each column follows its rule along ``seq``."""
    present = {n: r for n, r in rules.items() if n in rows.columns}
    return rows.groupBy(*keys).agg(*[_rule(r, n, F.col(seq)) for n, r in present.items()])


def fold_last(rows: DataFrame, keys: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """The whole last row of each key, nulls included."""
    rest = [x for x in rows.columns if x not in (*keys, seq)]
    last = F.max_by(F.struct(*rest), F.col(seq)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")


def merge(current: DataFrame, batch: DataFrame, keys: tuple[str, ...], rules: dict[str, str], seq: str = "seq") -> DataFrame:
    """Fold a batch into the current table; current rows come before any batch row."""
    base = current.withColumn(seq, F.lit(-1).cast(batch.schema[seq].dataType))
    return fold(base.unionByName(batch, allowMissingColumns=True), keys, rules, seq)


def merge_last(current: DataFrame, batch: DataFrame, keys: tuple[str, ...], preserve: tuple[str, ...] = (), seq: str = "seq") -> DataFrame:
    """Last write wins on every column; ``preserve`` keeps known values when the new one is null."""
    names = [x for x in batch.columns if x not in (*keys, seq)]
    rules = {x: LAST_KNOWN if x in preserve else LAST for x in names}
    return merge(current.select(*keys, *names), batch, keys, rules, seq)


def write_counts(current: DataFrame, batch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of the batch that insert and that update, repeats of a new key counting as updates."""
    per_key = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = current.select(*keys, F.lit(True).alias("known"))
    new = F.col("known").isNull()
    return (
        per_key.join(known, list(keys), "left")
        .agg(F.count_if(new).alias("inserted"), F.coalesce(F.sum("n"), F.lit(0)).alias("written"))
        .select("inserted", (F.col("written") - F.col("inserted")).alias("updated"))
    )


def years_replaced(current: DataFrame, batch: DataFrame, year: str = "source_year") -> DataFrame:
    """Batch rows plus current rows of years the batch does not hold."""
    kept = current.join(batch.select(year).distinct(), year, "left_anti")
    return kept.select(*current.columns).unionByName(batch.select(*current.columns))


def with_class_defaults(records: DataFrame) -> DataFrame:
    filled = {}
    for name, default in CLASS_DEFAULTS.items():
        given = F.col(name) if name in records.columns else F.lit(None).cast("string")
        filled[name] = F.coalesce(given, F.lit(default))
    return records.withColumns(filled)


def backfill_portal_fields(raw_records: DataFrame, key: str, fields: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """First non-empty value of every portal field over a record's raw rows."""
    first = []
    for name in fields:
        x = none_if_blank(F.col(name).cast("string"))
        first.append(F.min_by(x, F.when(x.isNotNull(), F.col(seq))).alias(name))
    return raw_records.groupBy(key).agg(*first)


def merge_records(current: DataFrame, batch: DataFrame, preserve_outcomes: bool = False, seq: str = "seq") -> DataFrame:
    """Stored records by storage key. Re-ingesting clears the outcome columns unless they are preserved."""
    from ..functions.cleaning import record_key

    keyed = batch.withColumn("procurement_record_key", record_key(F.col("procurement_id"), F.col("procurement_url")))
    keyed = keyed.where(F.col("procurement_record_key").isNotNull())
    outcomes = [x for x in OUTCOME_COLUMNS if x in current.columns and x not in keyed.columns]
    keyed = keyed.withColumns({x: F.lit(None).cast(current.schema[x].dataType) for x in outcomes})
    preserve = tuple(x for x in OUTCOME_COLUMNS if x in keyed.columns) if preserve_outcomes else ()
    return merge_last(current, keyed, ("procurement_record_key",), preserve, seq)


# Outcome columns that every outcome sets, and what it sets them to if it says nothing (fixed values).
OUTCOME_BLANKS = {
    "procurement_status_from_report": None, "procurement_winner": None, "procurement_winner_registration_no": None,
    "procurement_winner_suggested_price_eur": None, "procurement_winner_source": None, "procurement_participants_count": 0,
    "procurement_outcome_description": None, "bid_deadline": None, "decision_date": None, "funding_source": None,
    "eu_project_reference": None, "evaluation_method": None, "contract_scope_type": None, "is_multi_lot": False, "lot_count": None,
}


def apply_outcomes(records: DataFrame, outcomes: DataFrame, seq: str = "seq") -> DataFrame:
    """Write report outcomes onto records; list columns keep the old value when no new one came.

    Other outcome columns of a record are set even where the batch lacks them: to
    null, a count to 0, the lot flag to false.
    """
    names = [x for x in outcomes.columns if x not in ("procurement_id", seq)]
    rules = {x: LAST_KNOWN if x in KEPT_IF_MISSING else LAST for x in names}
    news = fold(outcomes.where(F.coalesce(F.col("procurement_id") != "", F.lit(False))), ("procurement_id",), rules, seq)
    news = news.select("procurement_id", F.struct(*names).alias("_new"))
    joined = records.join(news, "procurement_id", "left")
    hit = F.col("_new").isNotNull()
    updated = {}
    for name in names:
        new, old = F.col(f"_new.{name}"), (F.col(name) if name in records.columns else F.lit(None))
        updated[name] = F.coalesce(new, old) if name in KEPT_IF_MISSING else F.when(hit, new).otherwise(old)
    for name, blank in OUTCOME_BLANKS.items():
        if name in records.columns and name not in names:
            updated[name] = F.when(hit, F.lit(blank).cast(records.schema[name].dataType)).otherwise(F.col(name))
    return joined.withColumns(updated).drop("_new")


def disqualified(participants: Column) -> Column:
    """Name and reason of the disqualified participants of a list; null when none."""
    out = F.filter(participants, lambda p: F.coalesce(p["disqualified"], F.lit(False)))
    short = F.transform(out, lambda p: F.struct(p["name"].alias("name"), p["disqualification_reason"].alias("reason")))
    return F.when(F.size(out) > 0, short)
