"""Landed open-data files to typed tables: readers, field mappers, rejects, sinks."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as c
from ..functions import fixed

# Source field -> column of the announcement table (fixed values).
ANNOUNCEMENT_FIELDS = {
    "Iepirkuma_ID": "procurement_id",
    "Iepirkuma_nosaukums": "title",
    "Iepirkuma_identifikacijas_numurs": "identification_number",
    "Pasutitaja_nosaukums": "buyer",
    "Pasutitaja_registracijas_numurs": "buyer_reg_number",
    "Pasutitaja_registracijas_numura_veids": "buyer_reg_number_type",
    "Pasutitaja_PVS_ID": "buyer_pvs_id",
    "Augstak_stavosa_organizacija": "parent_organization",
    "Citu_pasutitaju_vajadzibam": "for_other_buyers",
    "Faktiskais_sanemejs": "actual_recipient",
    "Iepirkuma_prieksmeta_veids": "subject_type",
    "CPV_kods_galvenais_prieksmets": "cpv_main",
    "CPV_kodi_papildus_prieksmeti": "cpv_additional",
    "Iepirkuma_statuss": "status",
    "Iepirkuma_izsludinasanas_datums": "publication_date",
    "Piedavajumu_iesniegsanas_datums": "submission_deadline",
    "Piedavajumu_iesniegsanas_laiks": "submission_deadline_time",
    "Ieintereseto_personu_sanaksmes": "interested_parties_meeting",
    "Precu_vai_pakalpojumu_sniegsanas_vieta": "region",
    "Planotais_liguma_darbibas_termina_termina_veids": "contract_duration_type",
    "Planotais_liguma_darbibas_termins": "contract_duration",
    "Planota_liguma_darbibas_termina_mervieniba": "contract_duration_unit",
    "Planota_liguma_izpilde_no": "contract_start_date",
    "Planota_liguma_izpilde_lidz": "contract_end_date",
    "Ligumcenas_veids": "value_type",
    "Planota_ligumcena": "estimated_value_eur",
    "Planota_ligumcena_no": "value_min_eur",
    "Planota_ligumcena_lidz": "value_max_eur",
    "Ligumcenas_valuta": "value_currency",
    "Regulejosais_tiesibu_akts": "governing_law",
    "Proceduras_veids": "procedure_type",
    "Pasutitaja_kontaktpersona": "contact_person",
    "Piedavajuma_iesniegsanas_valoda": "submission_language",
    "Atsauce_uz_ES_projektiem_un_programmam": "eu_project_reference",
    "Vai_pielaujami_piedavajuma_varianti": "variants_allowed",
    "Uzvaretaja_izveles_metode": "winner_selection_method",
    "Iesniegsanas_vieta": "submission_place",
    "Hipersaite_EIS_kura_pieejams_zinojums": "eis_url",
    "Hipersaite_uz_IUB_publikaciju": "iub_url",
    "Ir_dalijums_dalas": "has_lots",
    "Dalu_iesniegsanas_nosacijumi": "lot_submission_conditions",
    "Iepirkuma_dalas_nr": "lot_number",
    "Iepirkuma_dalas_nosaukums": "lot_name",
    "Iepirkuma_dalas_statuss": "lot_status",
    "Dalas_planotais_liguma_darbibas_termina_termina_veids": "lot_contract_duration_type",
    "Dalas_planotais_liguma_darbibas_termins": "lot_contract_duration",
    "Dalas_planota_liguma_darbibas_termina_mervieniba": "lot_contract_duration_unit",
    "Dalas_planota_liguma_izpilde_no": "lot_contract_start_date",
    "Dalas_planota_liguma_izpilde_lidz": "lot_contract_end_date",
    "Dalas_ligumcenas_veids": "lot_value_type",
    "Dalas_planota_ligumcena": "lot_estimated_value_eur",
    "Dalas_planota_ligumcena_no": "lot_value_min_eur",
    "Dalas_planota_ligumcena_lidz": "lot_value_max_eur",
    "Dalas_ligumcenas_valuta": "lot_value_currency",
}
ANNOUNCEMENT_FLOATS = (
    "estimated_value_eur", "value_min_eur", "value_max_eur", "lot_estimated_value_eur", "lot_value_min_eur",
    "lot_value_max_eur",
)
ANNOUNCEMENT_INTS = ("buyer_pvs_id", "contract_duration", "lot_number", "lot_contract_duration")


def _raw(x: Column) -> Column:
    return x


def _key(x: Column) -> Column:
    return F.coalesce(c.strip(x), F.lit(""))


def _opt(x: Column) -> Column:
    return c.none_if_blank(c.strip(x))


def _truncated(x: Column) -> Column:
    return c.truncated_int(x)


@dataclass(frozen=True)
class Dataset:
    """How one landed dataset becomes a table.

    ``fields`` maps target column to (source field, expression); ``required``
    lists the columns a row must fill to be accepted.
    """

    fields: dict[str, tuple[str, Callable[[Column], Column]]]
    required: tuple[str, ...] = ()
    yearly: bool = True


RESULTS = Dataset(
    {
        "procurement_id": ("Iepirkuma_ID", c.unwrap_loose),
        "procurement_title": ("Iepirkuma_nosaukums", _raw),
        "buyer": ("Pasutitaja_nosaukums", _raw),
        "buyer_reg_number": ("Pasutitaja_registracijas_numurs", _opt),
        "winner_name": ("Uzvaretaja_nosaukums", _raw),
        "winner_reg_number": ("Uzvaretaja_registracijas_numurs", _opt),
        "contract_value_eur": ("Aktuala_liguma_summa", c.comma_float),
        "contract_value_original_eur": ("Sakotneja_liguma_summa", c.comma_float),
        "contract_signed_date": ("Liguma_dok_noslegsanas_datums", _raw),
    },
    ("procurement_id", "winner_reg_number"),
)
PARTICIPANTS = Dataset(
    {
        "procurement_id": ("Iepirkuma_ID", _key),
        "procurement_title": ("Iepirkuma_nosaukums", _raw),
        "identification_number": ("Iepirkuma_identifikacijas_numurs", _raw),
        "buyer": ("Pasutitaja_nosaukums", _raw),
        "buyer_reg_number": ("Pasutitaja_registracijas_numurs", _opt),
        "buyer_pvs_id": ("Pasutitaja_PVS_ID", _truncated),
        "parent_organization": ("Augstak_stavosa_organizacija", _raw),
        "status": ("Iepirkuma_statuss", _raw),
        "cpv_main": ("CPV_kods_galvenais_prieksmets", c.unwrap_loose),
        "subject_type": ("Iepirkuma_prieksmeta_veids", _raw),
        "estimated_value_eur": ("Planota_ligumcena", c.comma_float),
        "currency": ("Ligumcenas_valuta", _raw),
        "contract_duration_months": ("Planotais_liguma_darbibas_termins", _truncated),
        "submission_deadline": ("Piedavajumu_iesniegsanas_termins_datums", _opt),
        "participant_name": ("Pretendenta_nosaukums", _raw),
        "participant_reg_number": ("Pretendenta_registracijas_numurs", _opt),
        "participant_submitted_at": ("Pretendenta_piedavajuma_iesniegsanas_datums", _opt),
    },
    ("procurement_id", "participant_reg_number"),
)
AMENDMENTS = Dataset(
    {
        "procurement_id": ("Iepirkuma_ID", _key),
        "procurement_title": ("Iepirkuma_nosaukums", _raw),
        "identification_number": ("Iepirkuma_identifikacijas_numurs", _raw),
        "buyer": ("Pasutitaja_nosaukums", _raw),
        "buyer_reg_number": ("Pasutitaja_registracijas_numurs", _opt),
        "buyer_reg_number_type": ("Pasutitaja_registracijas_numura_veids", _raw),
        "buyer_pvs_id": ("Pasutitaja_PVS_ID", _truncated),
        "parent_organization": ("Augstak_stavosa_organizacija", _raw),
        "status": ("Iepirkuma_statuss", _raw),
        "announcement_date": ("Iepirkuma_izsludinasanas_datums", _raw),
        "amendment_date": ("Grozijumu_datums", _raw),
        "submission_deadline": ("Piedavajumu_iesniegsanas_datumlaiks", _raw),
        "interested_parties_meeting": ("Ieintereseto_personu_sanaksmes", _raw),
        "eu_project_reference": ("Atsauce_uz_ES_projektiem_un_programmam", _raw),
        "eis_url": ("Hipersaite_EIS_kura_pieejams_zinojums", _raw),
        "iub_url": ("Hipersaite_uz_IUB_publikaciju", _raw),
        "has_lots": ("Ir_dalijums_dalas", _raw),
        "lot_submission_conditions": ("Dalu_iesniegsanas_nosacijumi", _raw),
        "lot_number": ("Iepirkuma_dalas_nr", _truncated),
        "lot_name": ("Iepirkuma_dalas_nosaukums", _raw),
        "lot_status": ("Iepirkuma_dalas_statuss", _raw),
    },
    ("procurement_id",),
)
PURCHASE_ORDERS = Dataset(
    {
        "order_number": ("Pasutijuma_Nr", _raw),
        "order_status": ("Pasutijuma_statuss", _raw),
        "order_confirmed_date": ("Pasutijuma_apstiprinasanas_datums", _raw),
        "buyer": ("Pasutitajs", _raw),
        "buyer_reg_number": ("Pasutitaja_registracijas_numurs", _opt),
        "buyer_reg_number_type": ("Pasutitaja_registracijas_numura_veids", _raw),
        "parent_organization": ("Augstak_stavosa_organizacija", _raw),
        "supplier": ("Piegadatajs", _raw),
        "supplier_reg_number": ("Piegadataja_registracijas_numurs", _opt),
        "supplier_reg_number_type": ("Piegadataja_registracijas_numura_veids", _raw),
        "catalog_number": ("Kataloga_numurs", _raw),
        "catalog_name": ("Kataloga_nosaukums", _raw),
        "item_name": ("Pasutitas_preces_nosaukums", _raw),
        "item_manufacturer": ("Pasutitas_preces_razotajs", _raw),
        "max_delivery_date": ("Max_piegades_datums", _raw),
        "amount_eur_ex_vat": ("Summa_bez_PVN", c.comma_float),
        "vat_pct": ("PVN_proc", c.comma_float),
        "quantity": ("Pasutitas_skaits", c.comma_float),
    }
)
DELIVERIES = Dataset(
    {
        "order_number": ("PasutijumaNr", _raw),
        "waybill_number": ("Pavadzimes_nr", _raw),
        "delivery_status": ("Piegades_statuss", _raw),
        "buyer": ("Pasutitajs", _raw),
        "buyer_reg_number": ("Pasut_orgnr", _opt),
        "buyer_reg_number_type": ("Pasut_org_reg_nr_veids", _raw),
        "parent_organization": ("Augstak_stavosa_organizacija", _raw),
        "supplier": ("Piegadatajs", _raw),
        "supplier_reg_number": ("Piegnr", _opt),
        "supplier_reg_number_type": ("Pieg_org_nr_veids", _raw),
        "catalog_number": ("Kataloga_nr", _raw),
        "catalog_name": ("Kataloga_nos", _raw),
        "item_name": ("Preces_nosaukums", _raw),
        "item_manufacturer": ("Piegadatas_preces_razotajs", _raw),
        "purchase_created_date": ("Pirkuma_izveid_dat", _raw),
        "quality_approved_date": ("Kval_apstipr_dat", _raw),
        "delivery_address": ("Piegades_adrese", _raw),
        "amount_eur_ex_vat": ("Summa_bez_PVN", c.comma_float),
        "vat_pct": ("PVN_proc", c.comma_float),
        "quantity": ("Kval_skaits", c.comma_float),
    }
)
BUYERS = Dataset(
    {
        "organization": ("Organizacija", lambda x: F.coalesce(x, F.lit(""))),
        "reg_number": ("RegNr", _opt),
        "reg_number_type": ("RegNrVeids", _raw),
        "parent_organization": ("Augstak_stavosa_organizacija", _raw),
        "registered_date": ("RegDatums", _raw),
        "is_blocked": ("Blokets", c.portal_flag),
        "is_deleted": ("Dzests", c.portal_flag),
    },
    ("reg_number",),
    yearly=False,
)
DATASETS = {
    "results": RESULTS,
    "participants": PARTICIPANTS,
    "amendments": AMENDMENTS,
    "purchase_orders": PURCHASE_ORDERS,
    "deliveries": DELIVERIES,
    "buyers": BUYERS,
}


def raw_schema(dataset: Dataset) -> T.StructType:
    """All-text schema of a landed dataset."""
    sources = dict.fromkeys(src for src, _ in dataset.fields.values())
    return T.StructType([T.StructField(s, T.StringType()) for s in sources])


def read_landing(spark: SparkSession, root: str, name: str, first_year: int, last_year: int, fmt: str = "json") -> DataFrame:
    """Landed records of one dataset; yearly ones live in ``source_year=*`` folders.

    The year range is a partition filter, so files of other years are not listed
    into the scan. A single-file dataset is tagged year 0.
    """
    dataset = DATASETS[name]
    reader = spark.read.schema(raw_schema(dataset))
    if fmt == "csv":
        reader = reader.option("header", True)
    if not dataset.yearly:
        return reader.format(fmt).load(f"{root}/{name}").withColumn("source_year", F.lit(0))
    schema = raw_schema(dataset).add("source_year", T.IntegerType())
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(f"{root}/{name}").where(F.col("source_year").between(first_year, last_year))


def _source(raw: DataFrame, field: str) -> Column:
    return F.col(field).cast("string") if field in raw.columns else F.lit(None).cast("string")


def map_dataset(raw: DataFrame, dataset: Dataset) -> DataFrame:
    """Source fields to table columns; fields the file lacks become nulls."""
    out = [expr(_source(raw, src)).alias(col) for col, (src, expr) in dataset.fields.items()]
    if dataset.yearly:
        out.append(F.col("source_year").cast("int"))
    kept = [x for x in ("seq",) if x in raw.columns]
    return raw.select(*out, *kept)


def map_announcements(raw: DataFrame) -> DataFrame:
    """Announcement records to the 54-column table, title and address filled in."""
    out = {}
    for src, col in ANNOUNCEMENT_FIELDS.items():
        value = _source(raw, src)
        if col in ANNOUNCEMENT_FLOATS:
            out[col] = c.plain_float(value)
        elif col in ANNOUNCEMENT_INTS:
            out[col] = c.whole_number(value)
        else:
            out[col] = c.unwrap_strict(value)
    kept = [x for x in ("source_year", "seq") if x in raw.columns]
    flat = raw.select(*[v.alias(k) for k, v in out.items()], *kept)
    own = F.when(F.col("eis_url").startswith("http"), F.col("eis_url"))
    return flat.withColumns(
        {
            "title": F.coalesce("title", "procurement_id"),
            "eis_url": F.coalesce(own, F.concat(F.lit(fixed.PORTAL_PROCUREMENT), F.col("procurement_id"))),
        }
    )


def _complete(required: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for name in required:
        ok = ok & F.coalesce(F.col(name).cast("string") != "", F.lit(False))
    return ok


def accepted(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    return df.where(_complete(required))


def rejected(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    return df.where(~_complete(required))


def acceptance_counts(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Fetched, accepted and skipped rows in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(_complete(required)).alias("accepted"),
        F.count_if(~_complete(required)).alias("skipped"),
    )


def owners_by_reg(owners: DataFrame) -> DataFrame:
    """Distinct owner names per registration number, one row each: ``reg, owner``."""
    full_name = c.strip(F.concat_ws(" ", c.strip(F.coalesce("forename", F.lit(""))), c.strip(F.coalesce("surname", F.lit("")))))
    return (
        owners.select(c.strip(F.col("legal_entity_registration_number")).alias("reg"), full_name.alias("owner"))
        .where((F.col("reg") != "") & (F.col("owner") != ""))
        .distinct()
    )


def read_owners_csv(spark: SparkSession, path: str) -> DataFrame:
    from .schemas import OWNERS

    return spark.read.schema(OWNERS).option("sep", ";").option("header", True).csv(path)


def attach_register(companies: DataFrame, register: DataFrame) -> DataFrame:
    """Left join of the landed company register; a number it lacks gets ``not found``."""
    from ..functions.names import address_key, municipality

    entries = register.select(
        F.col("reg"),
        F.col("address"),
        address_key(F.col("address")).alias("address_key"),
        municipality(F.col("address")).alias("municipality"),
        F.coalesce("error", F.lit("")).alias("error"),
    )
    joined = companies.join(entries, "reg", "left")
    return joined.withColumn("error", F.coalesce("error", F.lit("not found")))


def read_project_lines(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """JSON lines, or a JSON array with ``multi_line``; items that are no objects are dropped."""
    bad = "_bad_record"
    reader = spark.read.schema(T.StructType(list(schema.fields) + [T.StructField(bad, T.StringType())]))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
    rows = reader.option("multiLine", multi_line).json(path)
    return rows.where(F.col(bad).isNull()).drop(bad)


def write_project_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_comparison(wide: DataFrame, long: DataFrame, folder: str) -> None:
    """Both comparison forms as CSV with headers."""
    wide.write.mode("overwrite").option("header", True).csv(f"{folder}/procurement_comparison")
    long.write.mode("overwrite").option("header", True).csv(f"{folder}/field_comparison")


def replace_years(df: DataFrame, path: str) -> None:
    """Replace only the year folders the batch holds; other years stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_year").parquet(path)


def overlay_report_columns(stored: DataFrame, raw_schema_ddl: str, json_column: str, overlay: list[str]) -> DataFrame:
    """Stored record JSON with the typed report columns laid over it."""
    parsed = stored.withColumn("_raw", F.from_json(json_column, raw_schema_ddl)).where(F.col("_raw").isNotNull())
    names = [f.name for f in T.StructType.fromDDL(raw_schema_ddl).fields if f.name not in overlay]
    return parsed.select(*[F.col(f"_raw.{n}").alias(n) for n in names], *overlay)


def records_by_keys(records: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Records whose key is listed; Spark broadcasts the keys when they are small."""
    return records.join(keys.select(key).distinct(), key, "left_semi").orderBy("year", "procurement_id", "procurement_url")
