"""Landing, mapping, roll-up and file round-trip queries over raw frames drawn from the star tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..operators import lots, merge
from ..session import shared_folder
from ..sources import landing, star
from .registry import query


def _excel(c):
    return F.concat(F.lit('="'), c.cast("string"), F.lit('"'))


def _comma(c):
    return F.replace(c.cast("string"), F.lit("."), F.lit(","))


# --- announcements ----------------------------------------------------------------


def raw_announcements(s, d):
    """One raw text row per order line, as the portal lists lots; orders without lines once."""
    key = F.col("o_orderkey")
    line = star.lines(s, d)
    return (
        star.table(s, d, "orders")
        .join(line, key == F.col("l_orderkey"), "left")
        .select(
            F.concat_ws("_", "l_partkey", "l_suppkey").alias("_id"),
            F.when(key % 100 != 99, _excel(key)).alias("Iepirkuma_ID"),
            F.when(key % 7 != 0, F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).alias("Iepirkuma_nosaukums"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("Pasutitaja_nosaukums"),
            _excel(star.reg_of(F.col("o_custkey"))).alias("Pasutitaja_registracijas_numurs"),
            F.col("o_custkey").cast("string").alias("Pasutitaja_PVS_ID"),
            F.concat(F.lit('="'), star.code_of(key), F.lit(' Darbi"')).alias("CPV_kods_galvenais_prieksmets"),
            F.col("o_orderstatus").alias("Iepirkuma_statuss"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("Iepirkuma_izsludinasanas_datums"),
            F.when(key % 5 == 0, "/Procurement/").when(key % 5 == 1, "eis.gov.lv/x").when(key % 5 == 2, "https://a.example/p").alias("u"),
            F.when(key % 4 != 1, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("Planota_ligumcena"),
            F.lit(None).cast("string").alias("Planota_ligumcena_lidz"),
            F.lit(None).cast("string").alias("Planota_ligumcena_no"),
            F.when(key % 3 == 0, "EUR").when(key % 3 == 1, "USD").alias("Ligumcenas_valuta"),
            F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("string")).alias("Iepirkuma_dalas_nr"),
            F.when(F.col("l_linenumber") != 3, _comma(F.col("value"))).alias("Dalas_planota_ligumcena"),
            F.when(F.col("l_linenumber") == 3, F.concat(F.lit(" "), F.col("value").cast("string"))).alias("Dalas_planota_ligumcena_lidz"),
            F.lit(None).cast("string").alias("Dalas_planota_ligumcena_no"),
            F.when(F.col("l_suppkey") % 5 == 0, "USD").alias("Dalas_ligumcenas_valuta"),
            F.year("o_orderdate").alias("source_year"),
            F.struct(-F.year("o_orderdate"), "l_linenumber", "l_partkey", "l_suppkey", "value").alias("seq"),
        )
        .withColumn("u", F.when(F.col("u").startswith("/"), F.concat("u", F.lit("x"))).otherwise(F.col("u")))
        .withColumnRenamed("u", "Hipersaite_EIS_kura_pieejams_zinojums")
    )


_RAW = """raw AS (SELECT o.*, l.*, CASE WHEN o_orderkey % 100 <> 99 THEN CAST(o_orderkey AS VARCHAR) END AS pid,
    'https://www.eis.gov.lv/EKEIS/Supplier/Procurement/' AS base FROM orders o LEFT JOIN lines l ON o_orderkey = l_orderkey)"""


@query(
    "ingest_announcements",
    f"""WITH {_RAW} SELECT pid AS procurement_id, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, pid) AS title,
    'C' || CAST(o_custkey AS VARCHAR) AS buyer, '4' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS buyer_reg_number,
    CAST(o_custkey AS INTEGER) AS buyer_pvs_id,
    CAST(o_orderkey % 90 + 10 AS VARCHAR) || '000000-' || CAST(o_orderkey % 10 AS VARCHAR) || ' Darbi' AS cpv_main,
    o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS publication_date,
    CASE WHEN o_orderkey % 4 <> 1 THEN o_totalprice END AS estimated_value_eur,
    CASE WHEN o_orderkey % 5 = 2 THEN 'https://a.example/p' ELSE base || pid END AS eis_url,
    CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS lot_number, CAST(NULL AS DOUBLE) AS lot_estimated_value_eur,
    CASE WHEN l_linenumber = 3 THEN CAST(value AS DOUBLE) END AS lot_value_max_eur
    FROM raw WHERE pid IS NOT NULL AND year(o_orderdate) BETWEEN 1996 AND 1998""",
)
def _(s, d):
    raw = raw_announcements(s, d).where(F.col("source_year").between(1996, 1998))
    mapped = landing.accepted(landing.map_announcements(raw), ("procurement_id",))
    return mapped.select(
        "procurement_id", "title", "buyer", "buyer_reg_number", "buyer_pvs_id", "cpv_main", "status", "publication_date",
        "estimated_value_eur", "eis_url", "lot_number", "lot_estimated_value_eur", "lot_value_max_eur",
    )


@query(
    "ingest_rejects",
    f"""WITH {_RAW} SELECT count(*) AS fetched, count(pid) AS accepted, count(*) - count(pid) AS skipped FROM raw""",
)
def _(s, d):
    return landing.acceptance_counts(landing.map_announcements(raw_announcements(s, d)), ("procurement_id",))


# --- other datasets ------------------------------------------------------------------


def raw_results(s, d):
    return star.lines(s, d).select(
        _excel(F.col("l_orderkey")).alias("Iepirkuma_ID"),
        F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("Iepirkuma_nosaukums"),
        F.concat(F.lit(" "), star.reg_of(F.col("l_partkey"))).alias("Pasutitaja_registracijas_numurs"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("Uzvaretaja_nosaukums"),
        F.when(F.col("l_suppkey") % 11 != 0, F.concat(star.reg_of(F.col("l_suppkey")), F.lit(" "))).alias("Uzvaretaja_registracijas_numurs"),
        _comma(F.col("value")).alias("Aktuala_liguma_summa"),
        F.when(F.col("l_linenumber") % 2 == 0, "nav").otherwise(F.col("value").cast("string")).alias("Sakotneja_liguma_summa"),
        F.date_format("l_shipdate", "dd.MM.yyyy").alias("Liguma_dok_noslegsanas_datums"),
        F.year("l_shipdate").alias("source_year"),
    )


@query(
    "ingest_results",
    """SELECT CAST(l_orderkey AS VARCHAR) AS procurement_id, 'T' || CAST(l_linenumber AS VARCHAR) AS procurement_title,
    CAST(NULL AS VARCHAR) AS buyer, '4' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS buyer_reg_number,
    'S' || CAST(l_suppkey AS VARCHAR) AS winner_name, '4' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS winner_reg_number,
    CAST(value AS DOUBLE) AS contract_value_eur, CASE WHEN l_linenumber % 2 <> 0 THEN CAST(value AS DOUBLE) END AS contract_value_original_eur,
    strftime(l_shipdate, '%d.%m.%Y') AS contract_signed_date, CAST(year(l_shipdate) AS INTEGER) AS source_year
    FROM lines WHERE l_suppkey % 11 <> 0""",
)
def _(s, d):
    return landing.accepted(landing.map_dataset(raw_results(s, d), landing.RESULTS), landing.RESULTS.required)


@query(
    "ingest_participants",
    """SELECT CAST(l_orderkey AS VARCHAR) AS procurement_id, CAST(l_linenumber AS INTEGER) AS buyer_pvs_id,
    CAST(l_partkey % 90 + 10 AS VARCHAR) || '000000-' || CAST(l_partkey % 10 AS VARCHAR) AS cpv_main,
    CAST(value AS DOUBLE) AS estimated_value_eur, CAST(l_quantity AS INTEGER) AS contract_duration_months,
    'S' || CAST(l_suppkey AS VARCHAR) AS participant_name, '4' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS participant_reg_number,
    strftime(l_shipdate, '%Y-%m-%d') AS participant_submitted_at, CAST(year(l_shipdate) AS INTEGER) AS source_year
    FROM lines WHERE l_suppkey % 11 <> 0""",
)
def _(s, d):
    raw = star.lines(s, d).select(
        F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("Iepirkuma_ID"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(".9")).alias("Pasutitaja_PVS_ID"),
        _excel(star.code_of(F.col("l_partkey"))).alias("CPV_kods_galvenais_prieksmets"),
        _comma(F.col("value")).alias("Planota_ligumcena"),
        F.col("l_quantity").cast("string").alias("Planotais_liguma_darbibas_termins"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("Pretendenta_nosaukums"),
        F.when(F.col("l_suppkey") % 11 != 0, star.reg_of(F.col("l_suppkey"))).otherwise(" ").alias("Pretendenta_registracijas_numurs"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" ")).alias("Pretendenta_piedavajuma_iesniegsanas_datums"),
        F.year("l_shipdate").alias("source_year"),
    )
    mapped = landing.accepted(landing.map_dataset(raw, landing.PARTICIPANTS), landing.PARTICIPANTS.required)
    return mapped.select(
        "procurement_id", "buyer_pvs_id", "cpv_main", "estimated_value_eur", "contract_duration_months", "participant_name",
        "participant_reg_number", "participant_submitted_at", "source_year",
    )


@query(
    "ingest_amendments",
    """SELECT CAST(l_orderkey AS VARCHAR) AS procurement_id, strftime(l_shipdate, '%d.%m.%Y') AS amendment_date,
    CAST(l_linenumber AS INTEGER) AS lot_number, l_linestatus AS lot_status, CASE WHEN l_linenumber > 1 THEN 'Jā' ELSE 'Nē' END AS has_lots,
    CAST(year(l_shipdate) AS INTEGER) AS source_year FROM lines""",
)
def _(s, d):
    raw = star.lines(s, d).select(
        F.col("l_orderkey").cast("string").alias("Iepirkuma_ID"),
        F.date_format("l_shipdate", "dd.MM.yyyy").alias("Grozijumu_datums"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")).alias("Iepirkuma_dalas_nr"),
        F.col("l_linestatus").alias("Iepirkuma_dalas_statuss"),
        F.when(F.col("l_linenumber") > 1, "Jā").otherwise("Nē").alias("Ir_dalijums_dalas"),
        F.year("l_shipdate").alias("source_year"),
    )
    mapped = landing.accepted(landing.map_dataset(raw, landing.AMENDMENTS), landing.AMENDMENTS.required)
    return mapped.select("procurement_id", "amendment_date", "lot_number", "lot_status", "has_lots", "source_year")


@query(
    "ingest_orders",
    """SELECT CAST(l_orderkey AS VARCHAR) AS order_number, l_linestatus AS order_status, name AS supplier,
    '4' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS supplier_reg_number, p_name AS item_name, p_brand AS item_manufacturer,
    CAST(value AS DOUBLE) AS amount_eur_ex_vat, l_tax AS vat_pct, l_quantity AS quantity, CAST(year(l_shipdate) AS INTEGER) AS source_year
    FROM lines JOIN sup ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
)
def _(s, d):
    raw = (
        star.lines(s, d)
        .join(star.suppliers(s, d), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(star.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("Pasutijuma_Nr"), F.col("l_linestatus").alias("Pasutijuma_statuss"), F.col("name").alias("Piegadatajs"),
            star.reg_of(F.col("l_suppkey")).alias("Piegadataja_registracijas_numurs"), F.col("p_name").alias("Pasutitas_preces_nosaukums"),
            F.col("p_brand").alias("Pasutitas_preces_razotajs"), _comma(F.col("value")).alias("Summa_bez_PVN"), _comma(F.col("l_tax")).alias("PVN_proc"),
            F.col("l_quantity").cast("string").alias("Pasutitas_skaits"), F.year("l_shipdate").alias("source_year"),
        )
    )
    return landing.map_dataset(raw, landing.PURCHASE_ORDERS).select(
        "order_number", "order_status", "supplier", "supplier_reg_number", "item_name", "item_manufacturer", "amount_eur_ex_vat", "vat_pct",
        "quantity", "source_year",
    )


@query(
    "ingest_deliveries",
    """SELECT CAST(l_orderkey AS VARCHAR) AS order_number, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS waybill_number,
    name AS supplier, '4' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS supplier_reg_number,
    strftime(l_shipdate, '%Y-%m-%d') AS quality_approved_date, CAST(value AS DOUBLE) AS amount_eur_ex_vat, l_tax AS vat_pct,
    l_quantity AS quantity, CAST(year(l_shipdate) AS INTEGER) AS source_year FROM lines JOIN sup ON l_suppkey = s_suppkey""",
)
def _(s, d):
    raw = (
        star.lines(s, d)
        .join(star.suppliers(s, d), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("PasutijumaNr"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("Pavadzimes_nr"),
            F.col("name").alias("Piegadatajs"), star.reg_of(F.col("l_suppkey")).alias("Piegnr"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("Kval_apstipr_dat"), _comma(F.col("value")).alias("Summa_bez_PVN"),
            _comma(F.col("l_tax")).alias("PVN_proc"), _comma(F.col("l_quantity")).alias("Kval_skaits"), F.year("l_shipdate").alias("source_year"),
        )
    )
    return landing.map_dataset(raw, landing.DELIVERIES).select(
        "order_number", "waybill_number", "supplier", "supplier_reg_number", "quality_approved_date", "amount_eur_ex_vat", "vat_pct", "quantity",
        "source_year",
    )


@query(
    "ingest_buyers",
    """SELECT c_name AS organization, '4' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS reg_number, c_mktsegment AS reg_number_type,
    CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS is_blocked,
    CASE WHEN c_custkey % 2 = 0 THEN true END AS is_deleted FROM customer WHERE c_custkey % 9 <> 0""",
)
def _(s, d):
    key = F.col("c_custkey")
    raw = star.table(s, d, "customer").select(
        F.col("c_name").alias("Organizacija"), F.when(key % 9 != 0, star.reg_of(key)).otherwise("  ").alias("RegNr"), F.col("c_mktsegment").alias("RegNrVeids"),
        F.when(key % 4 == 0, " Jā").when(key % 4 == 1, "Nē").when(key % 4 == 2, "kas?").alias("Blokets"),
        F.when(key % 2 == 0, "1").otherwise("").alias("Dzests"),
    )
    mapped = landing.accepted(landing.map_dataset(raw, landing.BUYERS), landing.BUYERS.required)
    return mapped.select("organization", "reg_number", "reg_number_type", "is_blocked", "is_deleted")


@query(
    "year_from_name",
    """SELECT source, CAST(nullif(regexp_extract(source || '-' || CAST(2000 + doc_id % 40 AS VARCHAR), '(20\\d{2})', 1), '') AS INTEGER) AS year,
    count(*) AS documents FROM documents GROUP BY ALL""",
)
def _(s, d):
    named = F.concat_ws("-", "source", (F.col("doc_id") % 40 + 2000).cast("string"))
    from ..functions.cleaning import year_in_name

    return star.table(s, d, "documents").groupBy("source", year_in_name(named).alias("year")).agg(F.count(F.lit(1)).alias("documents"))


@query(
    "owners_by_reg",
    """WITH o AS (SELECT '4' || lpad(CAST(c_nationkey AS VARCHAR), 10, '0') AS reg, trim(coalesce(c_mktsegment, '') || ' ' ||
      CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey % 5 AS VARCHAR) END) AS owner FROM customer)
    SELECT DISTINCT reg, owner, n_name || ' pilsēta' AS municipality,
    CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'not found' END AS error FROM o
    LEFT JOIN nation ON reg = '4' || lpad(CAST(n_nationkey AS VARCHAR), 10, '0')""",
)
def _(s, d):
    key = F.col("c_custkey")
    owners = star.table(s, d, "customer").select(
        star.reg_of(F.col("c_nationkey")).alias("legal_entity_registration_number"), F.col("c_mktsegment").alias("forename"),
        F.when(key % 3 != 0, (key % 5).cast("string")).alias("surname"),
    )
    n = F.col("n_nationkey")
    register = star.table(s, d, "nation").select(
        star.reg_of(n).alias("reg"), F.concat("n_name", F.lit(" pilsēta, LV-1001")).alias("address"), F.when(n % 2 == 1, "not found").alias("error")
    )
    joined = landing.attach_register(landing.owners_by_reg(owners), register)
    return joined.select("reg", "owner", "municipality", "error")


# --- roll-up ---------------------------------------------------------------------------

_ROLL = f"""{_RAW}, scoped AS (SELECT *, coalesce(pid, CASE o_orderkey % 5 WHEN 0 THEN 'https://www.eis.gov.lv/Procurement/x'
      WHEN 1 THEN 'https://www.eis.gov.lv/x' WHEN 2 THEN 'https://a.example/p' END) AS k FROM raw WHERE o_orderkey % 90 + 10 BETWEEN 40 AND 59),
    lot AS (SELECT k, CASE WHEN value IS NOT NULL AND l_suppkey % 5 <> 0 THEN coalesce(CASE WHEN l_linenumber <> 7 THEN CAST(l_linenumber AS VARCHAR)
      END, 'row_' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR)) END AS lot,
      max(CASE WHEN l_suppkey % 5 <> 0 THEN value END) AS v,
      max(CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 4 <> 1 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS p, count(*) AS n
      FROM scoped WHERE k IS NOT NULL GROUP BY ALL),
    est AS (SELECT k, max(p) AS project, sum(v) AS lots, CAST(sum(n) AS BIGINT) AS n FROM lot GROUP BY k)"""
_EST = """CAST(greatest(project, lots) AS DOUBLE) AS estimated_value_eur, CASE WHEN project IS NOT NULL AND lots IS NOT NULL
    THEN 'max(project, lots_sum)' WHEN project IS NOT NULL THEN 'project' WHEN lots IS NOT NULL THEN 'lots_sum' ELSE 'unknown' END
    AS estimated_value_source"""


def _scoped(s, d):
    return lots.code_scope(raw_announcements(s, d), ["4", "5"])


@query(
    "estimated_value_lots",
    f"WITH {_ROLL} SELECT k AS record_key, {_EST}, n AS raw_api_record_count FROM est",
)
def _(s, d):
    values = lots.estimated_values(_scoped(s, d))
    return values.withColumn("estimated_value_eur", F.col("estimated_value_eur").cast("double"))


_FIRST = """base AS (SELECT k, arg_min({'pid': pid, 'y': CAST(year(o_orderdate) AS INTEGER), 'c': 'C' || CAST(o_custkey AS VARCHAR),
      'st': o_orderstatus}, (-year(o_orderdate), coalesce(l_linenumber, -1), coalesce(l_partkey, -1), coalesce(l_suppkey, -1), coalesce(value, -1))) AS b
      FROM scoped WHERE k IS NOT NULL GROUP BY k)"""


@query(
    "records_first",
    f"""WITH {_ROLL}, {_FIRST} SELECT k AS record_key, b.pid AS procurement_id, b.y AS year, b.c AS purchaser_name,
    b.st AS procurement_status, n AS raw_api_record_count FROM base JOIN est USING (k)""",
)
def _(s, d):
    first = lots.first_records(_scoped(s, d))
    return first.select("record_key", "procurement_id", "year", "purchaser_name", "procurement_status", "raw_api_record_count")


@query(
    "collected_records",
    f"""WITH {_ROLL}, {_FIRST} SELECT k AS record_key, b.y AS year, {_EST} FROM base JOIN est USING (k)
    WHERE greatest(project, lots) >= 200000""",
)
def _(s, d):
    kept = lots.collected_records(raw_announcements(s, d), ["4", "5"], 200000.0)
    return kept.select("record_key", "year", F.col("estimated_value_eur").cast("double").alias("estimated_value_eur"), "estimated_value_source")


@query(
    "run_counts",
    f"""WITH {_ROLL}, {_FIRST} SELECT CAST(b.y AS VARCHAR) AS year, count(*) AS before_filter,
    count(*) FILTER (greatest(project, lots) >= 200000) AS after_filter FROM base JOIN est USING (k) GROUP BY 1""",
)
def _(s, d):
    every = lots.collected_records(raw_announcements(s, d), ["4", "5"])
    return lots.year_counts(every, every.where(F.col("estimated_value_eur") >= 200000))


_LABELS = ("building_design", "building_new_build", "Infrastructure_Build ", "odd label", "non_construction")


@query(
    "class_counts",
    """WITH l AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'building_design' WHEN 1 THEN 'building_new_build' WHEN 2 THEN 'infrastructure_build'
      WHEN 4 THEN 'non_construction' ELSE 'unknown' END AS label FROM orders)
    SELECT c.label, count(l.label) AS records FROM (VALUES ('building_design'), ('building_design_build'), ('building_supervision'),
    ('building_new_build'), ('building_renovation'), ('building_repair'), ('infrastructure_design'), ('infrastructure_build'),
    ('infrastructure_renovation_repair'), ('infrastructure_maintenance_service'), ('maintenance_cleaning_service'), ('non_construction'),
    ('unknown')) c(label) LEFT JOIN l USING (label) GROUP BY 1""",
)
def _(s, d):
    k = F.col("o_orderkey") % 6
    label = F.lit(None).cast("string")
    for i, word in enumerate(_LABELS):
        label = F.when(k == i, word).otherwise(label)
    return lots.class_counts(merge.with_class_defaults(star.table(s, d, "orders").select(label.alias("classification_final_category"))))


# --- lots of participants -----------------------------------------------------------------


def _lot_bids(s, d):
    line = star.lines(s, d).join(star.suppliers(s, d), F.col("l_suppkey") == F.col("s_suppkey"))
    return line.select(
        F.col("l_orderkey").cast("string").alias("procurement_id"), F.col("l_linenumber").alias("lot_number"), "name",
        F.struct("l_suppkey", "l_partkey", "value").alias("pos"), F.col("value").alias("price"), (F.col("l_returnflag") == "A").alias("won_lot"),
    )


@query(
    "lots_grouped",
    """SELECT CAST(l_orderkey AS VARCHAR) AS procurement_id, l_linenumber AS lot_number, count(*) AS participants,
    CAST(min(value) AS DOUBLE) AS lowest_price, arg_max(name, (l_suppkey, l_partkey, value)) FILTER (l_returnflag = 'A') AS winner
    FROM lines JOIN sup ON l_suppkey = s_suppkey WHERE l_linenumber <> 0 GROUP BY 1, 2""",
)
def _(s, d):
    return lots.lot_winners(_lot_bids(s, d)).withColumn("lowest_price", F.col("lowest_price").cast("double"))


@query(
    "lot_bids_per_participant",
    """SELECT CAST(l_orderkey AS VARCHAR) AS procurement_id, name, count(*) AS lot_bids, count(*) FILTER (l_returnflag = 'A') AS won_lots,
    count(value) AS priced_bids, CAST(min(value) AS DOUBLE) AS suggested_price_eur FROM lines JOIN sup ON l_suppkey = s_suppkey GROUP BY 1, 2""",
)
def _(s, d):
    each = lots.lot_bids_per_participant(_lot_bids(s, d))
    return each.withColumn("suggested_price_eur", F.col("suggested_price_eur").cast("double"))


# --- files -----------------------------------------------------------------------------------


def _folder(s):
    return f"{shared_folder(s)}/{uuid.uuid4().hex}"


@query("round_trip_jsonl", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(s, d):
    path = _folder(s)
    df = star.table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    landing.write_project_lines(df, path)
    return landing.read_project_lines(s, path, df.schema)


@query(
    "owners_csv",
    """SELECT DISTINCT '4' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS reg, 'Ren' || chr(65533) || ' ' || s_name AS owner FROM supplier WHERE s_suppkey % 7 <> 0""",
)
def _(s, d):
    """Owners from a semicolon file whose bytes are not all UTF-8; rows without a number or name go."""
    path, k = _folder(s), F.col("s_suppkey")
    rows = star.table(s, d, "supplier").select(
        F.when(k % 7 != 0, star.reg_of(k)).otherwise(" ").alias("legal_entity_registration_number"), F.lit("René").alias("forename"), F.col("s_name").alias("surname")
    )
    rows.write.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return landing.owners_by_reg(landing.read_owners_csv(s, path))


@query("round_trip_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(s, d):
    path = _folder(s)
    df = star.table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    landing.write_comparison(df, df.select("s_suppkey"), path)
    return s.read.schema(df.schema).option("header", True).csv(f"{path}/procurement_comparison")


@query(
    "landing_years",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS source_year, count(*) AS results FROM lineitem
    WHERE year(l_shipdate) BETWEEN 1996 AND 1999 AND l_suppkey % 11 <> 0 GROUP BY 1""",
)
def _(s, d):
    root = _folder(s)
    raw_results(s, d).write.partitionBy("source_year").json(f"{root}/results")
    landed = landing.read_landing(s, root, "results", 1996, 1999)
    mapped = landing.accepted(landing.map_dataset(landed, landing.RESULTS), landing.RESULTS.required)
    return mapped.groupBy("source_year").agg(F.count(F.lit(1)).alias("results"))


@query(
    "reload_overlay",
    """SELECT CAST(o_orderkey AS VARCHAR) AS procurement_id, o_orderpriority AS procurement_name,
    CASE WHEN o_orderkey % 2 = 0 THEN 'downloaded' END AS report_download_status FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def _(s, d):
    pid = F.col("o_orderkey").cast("string")
    stored = star.table(s, d, "orders").select(
        pid.alias("procurement_record_key"), F.year("o_orderdate").alias("year"), F.lit("").alias("procurement_url"),
        F.to_json(F.struct(pid.alias("procurement_id"), F.col("o_orderpriority").alias("procurement_name"), F.lit("stale").alias("report_download_status"))).alias("raw"),
        F.when(F.col("o_orderkey") % 2 == 0, "downloaded").alias("report_download_status"),
    )
    keys = star.lines(s, d).where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").cast("string").alias("procurement_record_key"))
    kept = stored.withColumn("procurement_id", F.col("procurement_record_key"))
    chosen = landing.records_by_keys(kept, keys, "procurement_record_key")
    ddl = "procurement_id string, procurement_name string, report_download_status string"
    return landing.overlay_report_columns(chosen.drop("procurement_id"), ddl, "raw", ["report_download_status"])


_UNCLASSED = "".join(f'"{x}":0,' for x in sorted(fixed.FINAL_CATEGORIES) if x != "unknown")


@query(
    "run_manifest",
    f"""WITH {_ROLL}, {_FIRST}, y AS (SELECT CAST(b.y AS VARCHAR) AS year, count(*) AS n, count(*) FILTER (greatest(project, lots) >= 200000) AS m
      FROM base JOIN est USING (k) GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS procurement_records_before_value_filter, CAST(sum(m) AS BIGINT) AS procurement_records,
    '{{' || string_agg('"' || year || '":' || CAST(n AS VARCHAR), ',' ORDER BY year) || '}}' AS counts_by_year_before_value_filter,
    '{{' || string_agg('"' || year || '":' || CAST(m AS VARCHAR), ',' ORDER BY year) || '}}' AS counts_by_year,
    '{{{_UNCLASSED}"unknown":' || CAST(sum(n) AS BIGINT) || '}}' AS classification_counts FROM y""",
)
def _(s, d):
    every = lots.collected_records(raw_announcements(s, d), ["4", "5"])
    manifest = lots.run_manifest(every, every.where(F.col("estimated_value_eur") >= 200000), lots.class_counts(merge.with_class_defaults(every)))
    return manifest


@query(
    "results_in_scope",
    """SELECT procurement_id, winner_reg_number, contract_value_eur FROM res
    WHERE CAST(procurement_id AS BIGINT) % 90 + 10 BETWEEN 40 AND 49 AND CAST(procurement_id AS BIGINT) % 100 <> 99""",
)
def _(s, d):
    from ..operators import views

    key = F.col("o_orderkey")
    raw = star.table(s, d, "orders").select(
        F.when(key % 100 != 99, _excel(key)).alias("Iepirkuma_ID"),
        F.concat(F.lit('="'), star.code_of(key), F.lit(' Darbi"')).alias("CPV_kods_galvenais_prieksmets"),
    )
    return views.results_in_code_scope(star.results(s, d), raw, "4").select("procurement_id", "winner_reg_number", "contract_value_eur")
