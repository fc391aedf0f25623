"""Lots: estimated values rolled up from lot rows, and bids grouped by lot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as c
from ..functions import fixed
from ..functions.cleaning import MONEY

PROJECT_VALUES = ("Planota_ligumcena", "Planota_ligumcena_lidz", "Planota_ligumcena_no")
LOT_VALUES = ("Dalas_planota_ligumcena", "Dalas_planota_ligumcena_lidz", "Dalas_planota_ligumcena_no")


def _euro(name: str) -> Column:
    return F.upper(F.coalesce(c.clean_cell(F.col(name)), F.lit(""))).isin("", "EUR")


def _value(name: str) -> Column:
    return c.cell_float(F.col(name)).try_cast(MONEY)


def code_scope(raw: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows whose normalised procurement code starts with one of the prefixes."""
    code = c.cpv_code(F.col("CPV_kods_galvenais_prieksmets"))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.coalesce(code.startswith(p), F.lit(False))
    return raw.where(hit)


def keyed_raw(raw: DataFrame) -> DataFrame:
    """Raw rows with their record key (id, else address); rows with neither are dropped."""
    pid = c.clean_cell(F.col("Iepirkuma_ID"))
    url = c.procurement_url(F.col("Hipersaite_EIS_kura_pieejams_zinojums"), pid)
    keyed = raw.withColumns({"record_key": F.coalesce(c.none_if_blank(pid), url), "procurement_url": url})
    return keyed.where(F.col("procurement_url").isNotNull())


def estimated_values(raw: DataFrame) -> DataFrame:
    """Lot-aware estimate per record.

    Project value is the greatest euro amount over all rows of a record; a lot
    counts once with its greatest amount; the estimate is the larger of the
    project value and the lot sum. Both levels aggregate partially before the
    shuffle, so a record with very many lot rows is no bottleneck.
    """
    project = F.when(_euro("Ligumcenas_valuta"), F.greatest(*[_value(x) for x in PROJECT_VALUES]))
    lot = F.when(_euro("Dalas_ligumcenas_valuta"), F.coalesce(*[_value(x) for x in LOT_VALUES]))
    number = c.none_if_blank(c.clean_cell(F.col("Iepirkuma_dalas_nr")))
    lot_key = F.when(lot.isNotNull(), F.coalesce(number, F.concat(F.lit("row_"), F.col("_id").cast("string"))))
    by_lot = (
        keyed_raw(raw)
        .select("record_key", lot_key.alias("lot"), lot.alias("lot_value"), project.alias("project_value"))
        .groupBy("record_key", "lot")
        .agg(F.max("lot_value").alias("lot_value"), F.max("project_value").alias("project_value"), F.count(F.lit(1)).alias("n"))
    )
    sums = by_lot.groupBy("record_key").agg(
        F.max("project_value").alias("project"), F.sum("lot_value").cast(MONEY).alias("lots"), F.sum("n").alias("raw_api_record_count")
    )
    p, s = F.col("project").isNotNull(), F.col("lots").isNotNull()
    source = F.when(p & s, "max(project, lots_sum)").when(p, "project").when(s, "lots_sum").otherwise("unknown")
    return sums.select(
        "record_key", F.greatest("project", "lots").alias("estimated_value_eur"), source.alias("estimated_value_source"), "raw_api_record_count"
    )


BASE_FIELDS = {
    "cpv_main": "CPV_kods_galvenais_prieksmets",
    "cpv_additional": "CPV_kodi_papildus_prieksmeti",
    "procurement_name": "Iepirkuma_nosaukums",
    "procurement_identification_number": "Iepirkuma_identifikacijas_numurs",
    "purchaser_name": "Pasutitaja_nosaukums",
    "purchaser_registration_no": "Pasutitaja_registracijas_numurs",
    "procurement_subject_type": "Iepirkuma_prieksmeta_veids",
    "procurement_status": "Iepirkuma_statuss",
    "publish_date": "Iepirkuma_izsludinasanas_datums",
    "submission_date": "Piedavajumu_iesniegsanas_datums",
    "submission_time": "Piedavajumu_iesniegsanas_laiks",
    "delivery_location": "Precu_vai_pakalpojumu_sniegsanas_vieta",
    "planned_contract_term_type": "Planotais_liguma_darbibas_termina_termina_veids",
    "planned_contract_term": "Planotais_liguma_darbibas_termins",
    "planned_contract_term_unit": "Planota_liguma_darbibas_termina_mervieniba",
    "planned_execution_from": "Planota_liguma_izpilde_no",
    "planned_execution_to": "Planota_liguma_izpilde_lidz",
    "procedure_type": "Proceduras_veids",
    "contact_person": "Pasutitaja_kontaktpersona",
    "submission_language": "Piedavajuma_iesniegsanas_valoda",
    "variants_allowed": "Vai_pielaujami_piedavajuma_varianti",
    "winner_selection_method": "Uzvaretaja_izveles_metode",
    "has_lots": "Ir_dalijums_dalas",
    "iub_publication_url": "Hipersaite_uz_IUB_publikaciju",
}


def first_records(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Base fields of the first raw row of each record and the count of its rows.

    The raw rows stay a table of their own under the same ``record_key``.
    """
    fields = [c.clean_cell(F.col(src)).alias(col) for col, src in BASE_FIELDS.items() if src in raw.columns]
    base = F.struct(c.clean_cell(F.col("Iepirkuma_ID")).alias("procurement_id"), F.col("source_year").alias("year"), *fields, "procurement_url")
    return (
        keyed_raw(raw)
        .groupBy("record_key")
        .agg(F.min_by(base, F.col(seq)).alias("base"), F.count(F.lit(1)).alias("raw_api_record_count"))
        .select("record_key", "base.*", "raw_api_record_count")
    )


def collected_records(raw: DataFrame, prefixes: list[str], min_value: float | None = None, seq: str = "seq") -> DataFrame:
    """The whole roll-up: code scope, first fields, estimate, value floor, order."""
    scoped = code_scope(raw, prefixes)
    joined = first_records(scoped, seq).join(estimated_values(scoped).drop("raw_api_record_count"), "record_key")
    if min_value is not None:
        joined = joined.where(F.col("estimated_value_eur") >= F.lit(min_value))
    return joined.orderBy(F.coalesce("year", F.lit(0)), F.coalesce("procurement_id", F.lit("")))


def year_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records per year before and after the value floor."""
    year = F.coalesce(F.col("year").cast("string"), F.lit("unknown")).alias("year")
    b = before.groupBy(year).agg(F.count(F.lit(1)).alias("before_filter"))
    a = after.groupBy(year).agg(F.count(F.lit(1)).alias("after_filter"))
    return b.join(a, "year", "left").withColumn("after_filter", F.coalesce("after_filter", F.lit(0)))


def run_manifest(before: DataFrame, after: DataFrame, classes: DataFrame) -> DataFrame:
    """Summary of one run as a single row; per-year and per-class counts are JSON objects.

    ``before`` and ``after`` are the records around the value floor, ``classes``
    the output of ``class_counts``; both key sets are small by nature.
    """
    years = year_counts(before, after)

    def as_map(key: str, value: str) -> Column:
        return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))))

    counted = years.agg(
        F.coalesce(F.sum("before_filter"), F.lit(0)).alias("procurement_records_before_value_filter"),
        F.coalesce(F.sum("after_filter"), F.lit(0)).alias("procurement_records"),
        as_map("year", "before_filter").alias("counts_by_year_before_value_filter"),
        as_map("year", "after_filter").alias("counts_by_year"),
    )
    return counted.withColumn("classification_counts", classes.agg(as_map("label", "records").alias("m")).scalar())


def class_counts(records: DataFrame, column: str = "classification_final_category") -> DataFrame:
    """Records per final category; every category appears, odd labels count as unknown."""
    label = F.lower(c.strip(F.coalesce(F.col(column), F.lit("unknown"))))
    known = F.when(label.isin(*fixed.FINAL_CATEGORIES), label).otherwise("unknown")
    counted = records.groupBy(known.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.createDataFrame([(x,) for x in fixed.FINAL_CATEGORIES], "label string")
    return every.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("records"))


def lots_of_participants(participants: Column) -> Column:
    """Participants of one document grouped by lot: ``{"lots": [...]}`` text, null when no lot is named.

    The winner of a lot is its last participant marked as winning it.
    """
    numbered = F.filter(participants, lambda p: F.coalesce(p["lot_number"] != 0, F.lit(False)))
    lots = F.array_distinct(F.transform(numbered, lambda p: p["lot_number"]))

    def one(lot: Column) -> Column:
        members = F.filter(numbered, lambda p: p["lot_number"] == lot)
        winners = F.filter(members, lambda p: F.coalesce(p["won_lot"], F.lit(False)))
        return F.struct(lot.alias("lot_number"), members.alias("participants"), F.try_element_at(winners, F.lit(-1))["name"].alias("winner"))

    return F.when(F.size(lots) > 0, F.to_json(F.struct(F.transform(lots, one).alias("lots"))))


def lot_winners(lot_bids: DataFrame) -> DataFrame:
    """Bids in long form to one row per (procurement, lot): bidders, lowest price, last winner."""
    won = F.when(F.col("won_lot"), F.col("pos"))
    return (
        lot_bids.where(F.coalesce(F.col("lot_number") != 0, F.lit(False)))
        .groupBy("procurement_id", "lot_number")
        .agg(F.count(F.lit(1)).alias("participants"), F.min("price").alias("lowest_price"), F.max_by("name", won).alias("winner"))
    )


def lot_bids_per_participant(lot_bids: DataFrame) -> DataFrame:
    """Per participant of a procurement: lots bid on, lots won, lowest price."""
    return lot_bids.groupBy("procurement_id", "name").agg(
        F.count(F.lit(1)).alias("lot_bids"),
        F.count_if("won_lot").alias("won_lots"),
        F.count("price").alias("priced_bids"),
        F.min("price").alias("suggested_price_eur"),
    )


def with_lot_bids(participants: Column, lots: Column) -> Column:
    """Participant structs of one document with their lot bids, won lots and prices attached.

    ``lots`` is the document's lot list ``array<struct<lot_number, participants>>``.
    The price becomes the lowest lot price when any is known.
    """
    bids = F.flatten(
        F.transform(
            lots,
            lambda lot: F.transform(
                lot["participants"],
                lambda q: F.struct(
                    q["name"].alias("name"), lot["lot_number"].alias("lot_number"), q["suggested_price_eur"].alias("price_eur"),
                    F.coalesce(q["is_winner"], F.lit(False)).alias("won"),
                ),
            ),
        )
    )

    def one(p: Column) -> Column:
        mine = F.filter(bids, lambda b: b["name"] == p["name"])
        prices = F.filter(F.transform(mine, lambda b: b["price_eur"]), lambda x: x.isNotNull())
        lots_won = F.transform(F.filter(mine, lambda b: b["won"]), lambda b: b["lot_number"])
        return F.struct(
            p["name"].alias("name"),
            F.coalesce(F.array_min(prices), p["suggested_price_eur"]).alias("suggested_price_eur"),
            F.when(F.size(prices) > 0, prices).otherwise(F.array(p["suggested_price_eur"])).alias("suggested_prices_eur"),
            F.transform(mine, lambda b: F.struct(b["lot_number"].alias("lot_number"), b["price_eur"].alias("price_eur"), b["won"].alias("won"))).alias("lot_bids"),
            lots_won.alias("won_lots"),
        )

    return F.transform(participants, one)
