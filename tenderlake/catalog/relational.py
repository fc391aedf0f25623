"""View, search and activity queries over the star tables."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import activity, alerts, contains, facts, search, views
from ..operators.facts import Filters, apply_filters
from ..plans import dashboard
from ..session import shared_folder
from ..sources import star
from .registry import query


def _ann(s, d):
    return star.announcements(s, d)


def _res(s, d):
    return star.results(s, d)


def _par(s, d, wide=False):
    return star.participants(s, d, wide)


# --- views --------------------------------------------------------------------

_ANN = "a.procurement_id, a.title, a.buyer, a.cpv_main, a.status, a.submission_deadline, a.estimated_value_eur, a.eis_url"


@query(
    "v_winners",
    f"""SELECT {_ANN}, r.winner_name, r.winner_reg_number, r.contract_value_eur, r.contract_signed_date, r.source_year AS result_year
    FROM ann a JOIN res r ON a.procurement_id = r.procurement_id""",
)
def _(s, d):
    return views.winners_view(_ann(s, d), _res(s, d))


@query(
    "v_participants",
    f"""SELECT {_ANN}, p.participant_name, p.participant_reg_number, p.participant_submitted_at, p.source_year AS participant_year
    FROM ann a JOIN par p ON a.procurement_id = p.procurement_id""",
)
def _(s, d):
    return views.participants_view(_ann(s, d), _par(s, d))


@query(
    "v_full",
    """SELECT p.procurement_id, p.procurement_title AS title, p.buyer, p.cpv_main, p.status, p.submission_deadline, p.estimated_value_eur,
    p.participant_name, p.participant_reg_number, p.participant_submitted_at, r.winner_name, r.winner_reg_number,
    r.winner_reg_number IS NOT NULL AS is_winner, r.contract_value_eur, r.contract_signed_date
    FROM wide p LEFT JOIN res r ON r.procurement_id = p.procurement_id AND r.winner_reg_number = p.participant_reg_number""",
)
def _(s, d):
    return views.full_view(_par(s, d, True), _res(s, d))


@query(
    "v_org_activity",
    """SELECT coalesce(r.winner_reg_number, p.participant_reg_number) AS reg_number, coalesce(r.winner_name, p.participant_name) AS org_name,
    count(DISTINCT r.procurement_id) AS procurements_won,
    CAST(sum(CAST(r.contract_value_eur AS DECIMAL(18,2))) AS DOUBLE) AS total_won_eur,
    count(DISTINCT p.procurement_id) AS procurements_participated,
    min(coalesce(r.contract_signed_date, p.submission_deadline)) AS first_activity,
    max(coalesce(r.contract_signed_date, p.submission_deadline)) AS last_activity
    FROM wide p FULL JOIN res r ON r.winner_reg_number = p.participant_reg_number AND r.procurement_id = p.procurement_id GROUP BY 1, 2""",
)
def _(s, d):
    return views.org_activity(_par(s, d, True), _res(s, d))


@query(
    "top_result",
    """SELECT procurement_id, winner_name, winner_reg_number, contract_value_eur, contract_signed_date FROM res
    QUALIFY row_number() OVER (PARTITION BY procurement_id ORDER BY contract_value_eur DESC NULLS LAST, winner_name, winner_reg_number) = 1""",
)
def _(s, d):
    return views.top_result(_res(s, d))


@query(
    "participant_count",
    """SELECT a.procurement_id, r.winner_name, r.contract_value_eur, coalesce(c.n, 0) AS participant_count FROM ann a
    LEFT JOIN (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY procurement_id
      ORDER BY contract_value_eur DESC NULLS LAST, winner_name, winner_reg_number) = 1) r USING (procurement_id)
    LEFT JOIN (SELECT procurement_id, count(*) AS n FROM par GROUP BY 1) c USING (procurement_id)""",
)
def _(s, d):
    joined = views.with_top_result(_ann(s, d), _res(s, d), _par(s, d))
    return joined.select("procurement_id", "winner_name", "contract_value_eur", "participant_count")


@query(
    "json_aggregates",
    """WITH m AS (SELECT procurement_id, 'participant' AS kind, participant_reg_number AS registration_no, participant_name AS name,
        CAST(NULL AS DOUBLE) AS value_eur FROM par
      UNION ALL SELECT procurement_id, 'winner', winner_reg_number, winner_name, contract_value_eur FROM res),
    t AS (SELECT procurement_id, count(*) FILTER (kind = 'winner') AS winner_count, count(*) FILTER (kind = 'participant') AS participant_count
      FROM m GROUP BY 1)
    SELECT m.*, CAST(row_number() OVER (PARTITION BY procurement_id, kind
      ORDER BY registration_no NULLS FIRST, name NULLS FIRST, value_eur NULLS FIRST) AS INTEGER) AS position,
      winner_count, participant_count FROM m JOIN t USING (procurement_id)""",
)
def _(s, d):
    return views.member_lists(_res(s, d), _par(s, d))


# --- scope ----------------------------------------------------------------------

_REGION = """CASE WHEN t = 'Latvija' THEN 'Visa Latvija' WHEN t IN ('Rīga', 'Jūrmala', 'Salaspils') THEN 'Rīga'
    WHEN t IN ('Cēsu novads', 'Balvu novads') THEN 'Vidzeme' WHEN t = 'Liepāja' THEN 'Kurzeme' WHEN t = 'Jelgava' THEN 'Zemgale'
    WHEN t = 'Daugavpils' THEN 'Latgale' ELSE 'Nezināms' END"""
_TOWN = """CASE WHEN region LIKE 'Jūrmala%' THEN 'Jūrmala' WHEN region LIKE 'Cēsu%' THEN 'Cēsu novads' WHEN region LIKE 'Brīvības%'
    THEN 'Salaspils' WHEN region = '-' THEN 'Nav norādīta' ELSE region END"""


@query(
    "scoped_rows",
    f"""SELECT procurement_id, year, buyer_normalized, location_bucket, planning_region, category, is_multi_lot, winner_normalized,
    procurement_winner_suggested_price_eur FROM (SELECT a.procurement_id, CAST(year(deadline) AS INTEGER) AS year,
      upper(buyer) AS buyer_normalized, {_TOWN} AS t, t AS location_bucket, {_REGION} AS planning_region,
      CASE WHEN coalesce(cpv_main, '') = '' THEN 'unknown' ELSE cpv_main[1:2] END AS category, coalesce(has_lots = 'Jā', false) AS is_multi_lot,
      coalesce(upper(replace(replace(r.winner_name, 'SIA "', ''), '"', '')), 'Nav norādīts') AS winner_normalized,
      r.contract_value_eur AS procurement_winner_suggested_price_eur
    FROM ann a LEFT JOIN (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY procurement_id
      ORDER BY contract_value_eur DESC NULLS LAST, winner_name, winner_reg_number) = 1) r USING (procurement_id)
    WHERE status IN ('Līgums noslēgts', 'Noslēgts', 'Lēmums pieņemts', 'Uzsākta līguma slēgšana'))""",
)
def _(s, d):
    ann = facts.awarded_scope(_ann(s, d))
    rows = facts.portal_rows(ann, _res(s, d), _par(s, d))
    prefix = F.when(F.coalesce(F.col("cpv_main"), F.lit("")) == "", "unknown").otherwise(F.substring("cpv_main", 1, 2))
    return rows.select(
        "procurement_id", "year", "buyer_normalized", "location_bucket", "planning_region", prefix.alias("category"), "is_multi_lot",
        "winner_normalized", F.col("procurement_winner_suggested_price_eur").cast("double").alias("procurement_winner_suggested_price_eur"),
    )


@query(
    "filtered_rows",
    """SELECT procurement_id, purchaser_name, category FROM mrows
    WHERE year = 1997 AND planning_region = 'ASIA' AND category = 'BUILDING' AND NOT is_multi_lot""",
)
def _(s, d):
    wanted = Filters(year=1997, planning_region="ASIA", category="BUILDING", multi_lot=False)
    return apply_filters(star.market_rows(s, d), wanted).select("procurement_id", "purchaser_name", "category")


@query(
    "multi_lot_scope",
    """SELECT count(*) FILTER (has_lots = 'Jā') AS with_lots, count(*) FILTER (has_lots IS DISTINCT FROM 'Jā') AS without_lots
    FROM ann WHERE status = 'Līgums noslēgts'""",
)
def _(s, d):
    with_lots = facts.awarded_scope(_ann(s, d), True).agg(F.count(F.lit(1)).alias("with_lots"))
    without = facts.awarded_scope(_ann(s, d), False).agg(F.count(F.lit(1)).alias("n")).scalar()
    return with_lots.select("with_lots", without.alias("without_lots"))


@query(
    "enriched_rows",
    f"""WITH r AS (SELECT m.*, {_REGION} AS region_found, c.c_nationkey FROM (SELECT *, CASE WHEN lower(delivery_location) LIKE '%asia%' THEN 'Jelgava'
      WHEN delivery_location LIKE '%EUROPE' THEN 'Latvija' ELSE delivery_location END AS t FROM mrows) m JOIN customer c ON c_name = purchaser_name)
    SELECT procurement_id, year, CASE WHEN t IN ('Jelgava', 'Latvija') THEN t ELSE split_part(t, ',', 1) END AS location_bucket, region_found AS planning_region,
    buyer_normalized, CASE WHEN CAST(procurement_winner_no AS BIGINT) % 4 = 0 THEN 'Company ' || procurement_winner_no ELSE coalesce(winner_normalized, 'Nav norādīts') END
      AS winner_display_name, CASE WHEN category = 'BUILDING' THEN 'unknown' ELSE category END AS category, is_multi_lot,
    CAST(award AS DOUBLE) AS award FROM (SELECT r.*, (SELECT CAST(decided.winner AS VARCHAR) FROM decided WHERE CAST(l_orderkey AS VARCHAR) = r.procurement_id)
      AS procurement_winner_no FROM r) WHERE CAST(procurement_id AS BIGINT) % 7 <> 0""",
)
def _(s, d):
    rows = star.market_rows(s, d)
    k = F.col("procurement_id").cast("long")
    place = F.col("delivery_location")
    town = F.when(F.lower(place).contains("asia"), "Jelgava").when(place.endswith("EUROPE"), "Visā Latvijas Republikas teritorijā").otherwise(place)
    records = rows.select(
        "procurement_id", "year", "purchaser_name", "procurement_winner", "procurement_participants_count", "lot_count", "is_multi_lot",
        F.when(k % 7 != 0, F.concat(F.lit("Data/construction_2023_2025/reports/"), "procurement_id")).otherwise("other/x").alias("report_document_path"),
        town.alias("delivery_location"), facts.AWARD, facts.ESTIMATE,
        F.when(F.col("category") == "BUILDING", '{"x": 1}').otherwise(F.col("category")).alias("contract_scope_type"),
        F.col("procurement_winner_registration_no").cast("long").alias("winner_company_id"),
    )
    companies = star.table(s, d, "supplier").where(F.col("s_suppkey") % 4 == 0).select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("Company "), F.col("s_suppkey").cast("string")).alias("canonical_name")
    )
    done = facts.enrich(facts.report_scope(records), companies)
    return done.select(
        "procurement_id", "year", "location_bucket", "planning_region", "buyer_normalized", "winner_display_name", "category", "is_multi_lot",
        F.col(facts.AWARD).cast("double").alias("award"),
    )


@query(
    "portal_bids",
    """SELECT procurement_id, participant_name AS name, upper(replace(replace(participant_name, 'SIA "', ''), '"', '')) AS norm_name,
    participant_reg_number AS reg, CAST(NULL AS DOUBLE) AS price FROM par""",
)
def _(s, d):
    bids = facts.bids_from_participants(_par(s, d))
    return bids.select("procurement_id", "name", "norm_name", "reg", F.col("price").cast("double").alias("price"))


_CATEGORY_NAMES = ", ".join(f"('{x}')" for x in sorted(set(fixed.CPV_LABELS.values())))


@query(
    "portal_filters",
    f"""SELECT 'year' AS kind, CAST(year(deadline) AS VARCHAR) AS value FROM ann WHERE deadline IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'buyer', buyer FROM ann GROUP BY ALL
    UNION ALL SELECT DISTINCT 'planning_region', {_REGION} FROM (SELECT {_TOWN} AS t FROM ann)
    UNION ALL SELECT 'category', x FROM (VALUES {_CATEGORY_NAMES}) v(x)""",
)
def _(s, d):
    return dashboard.portal_filters(_ann(s, d))


# --- search -----------------------------------------------------------------------

TODAY = date(1998, 1, 1)
_SHOWN = """SELECT coalesce(procurement_id, '') AS procurement_id, coalesce(title, '') AS title, coalesce(buyer, '') AS buyer,
    coalesce(region, '') AS region, coalesce(cpv_main, '') AS cpv_main, coalesce(publication_date, '') AS publication_date,
    coalesce(submission_deadline, '') AS submission_deadline, coalesce(status, '') AS status,
    coalesce(procedure_type, '') AS procedure_type, coalesce(eis_url, '') AS eis_url, estimated_value_eur,
    '{reason}' AS match_reason FROM ann WHERE {where} ORDER BY {order} LIMIT 50"""
_OPEN = """status IN ('Izsludināts', 'Pieteikumi/piedāvājumi atvērti')
    AND (submission_deadline IS NULL OR submission_deadline = '' OR deadline >= DATE '1998-01-01')"""
_CLOSED = "status IN ('Līgums noslēgts', 'Noslēgts', 'Izbeigts', 'Pārtraukts', 'Lēmums pieņemts', 'Uzsākta līguma slēgšana')"
_NEWEST = "ann.publication_date DESC NULLS FIRST, ann.procurement_id"
_SEARCHES = {
    "search_open": (search.Query(TODAY), _OPEN, _NEWEST, "Matched all tenders"),
    "search_category": (
        search.Query(TODAY, category="it", cpv_prefixes=("45",), similar_cpv_prefixes=("71",), similar_companies=("Acme",), sort="deadline"),
        _OPEN + " AND (cpv_main LIKE '45%' OR cpv_main LIKE '71%' OR cpv_main LIKE '72%' OR cpv_main LIKE '48%')",
        "deadline ASC NULLS LAST, ann.procurement_id",
        "Matched by CPV 45, 72, 48; similar to Acme (CPV 71)",
    ),
    "search_closed_region": (
        search.Query(TODAY, status="closed", planning_region="Rīga", keywords=("build", "URGENT"), sort="value_desc", locale="lv"),
        _CLOSED + """ AND (title ILIKE '%build%' OR title ILIKE '%urgent%') AND (region ILIKE '%rīga%' OR region ILIKE '%jūrmala%'
        OR region ILIKE '%salaspils%')""",
        "estimated_value_eur DESC NULLS LAST, ann.procurement_id",
        "Atrasts pēc: atslēgvārdi: build, URGENT; reģions Rīga",
    ),
    "search_all_filters": (
        search.Query(
            TODAY, status="all", subject_type="works", value_min_eur=50000.0, value_max_eur=300000.0, deadline_days=400,
            procedure_type="2-HIGH", pub_date_from="1997-06-01", pub_date_to="1999-01-31", buyer="customer", cpv_code="4",
        ),
        """cpv_main LIKE '4%' AND buyer ILIKE '%customer%' AND subject_type = 'Būvdarbi' AND estimated_value_eur BETWEEN 50000 AND 300000
        AND deadline BETWEEN DATE '1998-01-01' AND DATE '1998-01-01' + 400 AND procedure_type = '2-HIGH'
        AND publication_date >= '1997-06-01' AND publication_date <= '1999-01-31'""",
        _NEWEST,
        "Matched all tenders",
    ),
    "search_exact_status": (
        search.Query(TODAY, status="Pārtraukts", planning_region="All Latvia", sort="relevance"), "status = 'Pārtraukts'", _NEWEST,
        "Matched all tenders",
    ),
    "search_unknown_region": (
        search.Query(TODAY, status="all", planning_region="Cēsis"), "region ILIKE '%cēsis%'", _NEWEST, "Matched by region Cēsis",
    ),
}
for _name, (_q, _where, _order, _reason) in _SEARCHES.items():
    query(_name, _SHOWN.format(where=_where, order=_order, reason=_reason))(lambda s, d, _q=_q: search.search(_ann(s, d), _q))


@query(
    "search_match_count",
    f"SELECT count(*) AS match_count, CAST(least(count(*), 50) AS BIGINT) AS total_count FROM ann WHERE {_OPEN}",
)
def _(s, d):
    return search.match_count(_ann(s, d), search.Query(TODAY))


@query("procedure_types", "SELECT DISTINCT o_orderpriority AS procedure_type FROM orders WHERE o_orderpriority <> ''")
def _(s, d):
    return search.procedure_types(_ann(s, d))


SAVED = {
    "open": (search.Query(TODAY), "1997-12-01"),
    "works": (search.Query(TODAY, status="all", subject_type="works"), "2000-01-01"),
    "build": (search.Query(TODAY, status="closed", keywords=("building",)), "1999-06-30"),
}
_ALERTS = f"""SELECT 'open' AS filter_id, count(*) FILTER (publication_date > '1997-12-01') AS new_count,
    max(publication_date) AS newest_publication_date FROM ann WHERE {_OPEN}
    UNION ALL SELECT 'works', count(*) FILTER (publication_date > '2000-01-01'), max(publication_date) FROM ann WHERE subject_type = 'Būvdarbi'
    UNION ALL SELECT 'build', count(*) FILTER (publication_date > '1999-06-30'), max(publication_date) FROM ann
    WHERE {_CLOSED} AND title ILIKE '%building%'"""


@query("alerts_new", _ALERTS)
def _(s, d):
    return alerts.alert_counts(_ann(s, d), alerts.saved_searches(s, SAVED), TODAY)


def saved_of_customers(s, d):
    """A saved search per customer, of six kinds: by code, word, buyer, category, status and value, region and date."""
    k = F.col("c_custkey")
    kind = k % 6
    text = lambda when, value: F.when(when, value)
    none = F.lit(None)
    return star.table(s, d, "customer").select(
        F.concat(F.lit("saved-"), k.cast("string")).alias("filter_id"),
        F.date_format(F.date_add(F.lit(TODAY), -(k % 1500).cast("int")), "yyyy-MM-dd").alias("baseline"),
        text(kind == 3, F.element_at(F.array(*map(F.lit, ("construction", "it", "supplies", "unknown"))), (k % 4 + 1).cast("int"))).alias("category"),
        text(kind == 0, F.array(F.concat((k % 90 + 10).cast("string"), F.lit("0000")), (k % 89 + 10).cast("string"))).alias("cpv_prefixes"),
        none.cast("array<string>").alias("similar_cpv_prefixes"),
        text(kind == 4, (k % 90 + 10).cast("string")).alias("cpv_code"),
        text(kind == 1, F.array(F.concat(F.lit(" "), (k * 7).cast("string")), F.lit("mach%1-urg_nt"))).alias("keywords"),
        text(kind == 2, F.substring("c_name", -5, 5)).alias("buyer"),
        text(kind == 5, F.element_at(F.array(*map(F.lit, ("Rīga", "Latgale", "Cēsis", "All Latvia"))), (k % 4 + 1).cast("int"))).alias("planning_region"),
        F.element_at(F.array(*map(F.lit, ("all", "open", "closed", "Pārtraukts", ""))), (k % 5 + 1).cast("int")).alias("status"),
        text(k % 7 == 0, F.lit("works")).alias("subject_type"),
        text(kind == 4, (k % 40 * 5000).cast("double")).alias("value_min_eur"),
        text(kind == 4, F.lit(250000.0)).alias("value_max_eur"),
        text(k % 11 == 0, F.lit(400)).alias("deadline_days"),
        text(kind == 5, F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "5-LOW"))), (k % 3 + 1).cast("int"))).alias("procedure_type"),
        text(kind == 5, F.date_format(F.date_add(F.lit(TODAY), -(k % 2000).cast("int")), "yyyy-MM-dd")).alias("pub_date_from"),
        text(kind == 5, F.date_format(F.date_add(F.lit(TODAY), 90 - (k % 2000).cast("int")), "yyyy-MM-dd")).alias("pub_date_to"),
    )


_DAY = f"DATE '{TODAY}'"
_SAVED = f"""s AS (SELECT 'saved-' || c_custkey AS filter_id, c_custkey AS k, c_custkey % 6 AS kind, right(c_name, 5) AS who,
      strftime({_DAY} - CAST(c_custkey % 1500 AS INTEGER), '%Y-%m-%d') AS baseline,
      CASE WHEN c_custkey % 6 = 3 THEN ['construction', 'it', 'supplies', 'unknown'][c_custkey % 4 + 1] END AS category,
      CASE WHEN c_custkey % 6 = 5 THEN ['Rīga', 'Latgale', 'Cēsis', 'All Latvia'][c_custkey % 4 + 1] END AS area,
      ['all', 'open', 'closed', 'Pārtraukts', 'open'][c_custkey % 5 + 1] AS st,
      CASE WHEN c_custkey % 6 = 5 THEN ['1-URGENT', '2-HIGH', '5-LOW'][c_custkey % 3 + 1] END AS proc,
      strftime({_DAY} - CAST(c_custkey % 2000 AS INTEGER), '%Y-%m-%d') AS since,
      strftime({_DAY} + 90 - CAST(c_custkey % 2000 AS INTEGER), '%Y-%m-%d') AS till FROM customer),
    hit AS (SELECT filter_id, baseline, publication_date FROM s JOIN ann ON
      (kind <> 0 OR starts_with(cpv_main, k % 90 + 10 || '0000') OR starts_with(cpv_main, CAST(k % 89 + 10 AS VARCHAR)))
      AND (kind <> 1 OR title ILIKE '% ' || k * 7 || '%' OR title ILIKE '%mach%1-urg_nt%')
      AND (kind <> 2 OR contains(buyer, who))
      AND (category IS NULL OR category = 'unknown' OR left(cpv_main, 2) IN (SELECT unnest(CASE category WHEN 'construction' THEN ['45'] WHEN 'it' THEN ['72', '48'] ELSE ['34', '39', '44'] END)))
      AND (kind <> 4 OR (starts_with(cpv_main, CAST(k % 90 + 10 AS VARCHAR)) AND estimated_value_eur >= k % 40 * 5000 AND estimated_value_eur <= 250000))
      AND (kind <> 5 OR ((area = 'All Latvia' OR (area = 'Rīga' AND regexp_matches(lower(region), 'rīga|jūrmala|ādažu|ķekavas|mārupes|olaines|ropažu|salaspils|siguldas|ogres'))
        OR (area = 'Latgale' AND regexp_matches(lower(region), 'daugavpils|krāslavas|ludzas|preiļu|rēzekne|augšdaugavas')) OR (area = 'Cēsis' AND contains(lower(region), 'cēsis')))
        AND procedure_type = proc AND publication_date >= since AND publication_date <= till))
      AND (st = 'all' OR (st = 'open' AND {_OPEN}) OR (st = 'closed' AND {_CLOSED}) OR status = st)
      AND (k % 7 <> 0 OR subject_type = 'Būvdarbi') AND (k % 11 <> 0 OR deadline BETWEEN {_DAY} AND {_DAY} + 400))
    SELECT s.filter_id, count(*) FILTER (publication_date > hit.baseline) AS new_count, max(publication_date) AS newest_publication_date
    FROM s LEFT JOIN hit USING (filter_id) GROUP BY 1"""


ALERTS_SAVED = f"WITH {_SAVED}"


@query("alerts_saved", ALERTS_SAVED)
def _(s, d):
    """A saved search of every customer against all announcements."""
    return alerts.alert_counts(_ann(s, d), saved_of_customers(s, d), TODAY)


# --- activity ----------------------------------------------------------------------

NAME = "#00000000"
REG = "40000000003"
_DATE = """CASE WHEN regexp_full_match({x}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST({x} AS DATE)
    WHEN regexp_full_match({x}, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN CAST(strptime({x}, '%d.%m.%Y') AS DATE) END"""
_ITEM = """a.procurement_id, coalesce(title, '') AS title, coalesce(buyer, '') AS buyer, coalesce(cpv_main, '') AS cpv_main,
    coalesce(submission_deadline, '') AS submission_deadline, estimated_value_eur, coalesce(eis_url, '') AS eis_url,
    coalesce(status, '') AS status"""


@query(
    "activity_participations",
    f"""SELECT {_ITEM}, CAST(NULL AS DOUBLE) AS contract_value_eur, CAST(NULL AS VARCHAR) AS signed_date FROM ann a
    WHERE procurement_id IN (SELECT procurement_id FROM par WHERE participant_name ILIKE '%{NAME}%')
    ORDER BY coalesce(deadline, CAST(publication_date AS DATE)) DESC NULLS LAST, procurement_id DESC LIMIT 20""",
)
def _(s, d):
    return activity.participations(_ann(s, d), _par(s, d), NAME)


@query(
    "activity_wins",
    f"""SELECT {_ITEM}, r.contract_value_eur, r.contract_signed_date AS signed_date FROM ann a JOIN (SELECT * FROM res
      WHERE winner_reg_number = '{REG}' QUALIFY row_number() OVER (PARTITION BY procurement_id ORDER BY signed DESC) = 1) r USING (procurement_id)
    ORDER BY r.signed DESC NULLS LAST, procurement_id DESC LIMIT 20""",
)
def _(s, d):
    return activity.wins(_ann(s, d), _res(s, d), "", REG)


@query(
    "activity_stats",
    f"""WITH p AS (SELECT DISTINCT procurement_id FROM par WHERE participant_name ILIKE '%{NAME}%'),
    w AS (SELECT DISTINCT procurement_id FROM res WHERE winner_name ILIKE '%{NAME}%'),
    u AS (SELECT * FROM p UNION SELECT * FROM w)
    SELECT (SELECT count(*) FROM u) AS total_contracts, (SELECT count(*) FROM p) AS total_bids, (SELECT count(*) FROM w) AS total_wins,
    round(CAST((SELECT count(*) FROM w) AS DOUBLE) / (SELECT count(*) FROM u), 3) AS win_rate,
    (SELECT CAST(sum(CAST(contract_value_eur AS DECIMAL(18,2))) AS DOUBLE) FROM res WHERE winner_name ILIKE '%{NAME}%') AS total_won_value_eur""",
)
def _(s, d):
    return activity.stats(_par(s, d), _res(s, d), NAME)


@query(
    "company_cpv_profile",
    f"""SELECT cpv_prefix, CAST(sum(w) AS BIGINT) AS weight, CASE cpv_prefix {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SEARCH_CPV_LABELS.items())} ELSE 'CPV ' || cpv_prefix || 'xxx' END AS label
    FROM (SELECT cpv_main[1:2] AS cpv_prefix, 1 AS w FROM par JOIN ann USING (procurement_id)
      WHERE participant_name ILIKE '%{NAME}%' AND cpv_main <> ''
      UNION ALL SELECT cpv_main[1:2], 3 FROM res JOIN ann USING (procurement_id) WHERE winner_name ILIKE '%{NAME}%' AND cpv_main <> '')
    GROUP BY cpv_prefix ORDER BY weight DESC, cpv_prefix LIMIT 5""",
)
def _(s, d):
    return activity.code_profile(_ann(s, d), _par(s, d), _res(s, d), NAME)


@query(
    "company_suggest",
    """SELECT name, nullif(reg, '') AS reg_number FROM (SELECT participant_name AS name, participant_reg_number AS reg FROM par
      UNION ALL SELECT winner_name, winner_reg_number FROM res) WHERE name ILIKE '%supplier%' AND name NOT LIKE '=%'
    GROUP BY name, reg ORDER BY count(*) DESC, name, reg LIMIT 8""",
)
def _(s, d):
    return activity.suggestions(_par(s, d), _res(s, d), " supplier ")


@query(
    "company_candidates",
    """WITH w AS (SELECT winner_name AS name, count(*) AS wins FROM res WHERE winner_name ILIKE '%supplier%' GROUP BY 1),
    p AS (SELECT participant_name AS name, count(*) AS participations FROM par WHERE participant_name ILIKE '%supplier%' GROUP BY 1)
    SELECT coalesce(w.name, p.name) AS name, coalesce(wins, 0) AS wins, coalesce(participations, 0) AS participations
    FROM w FULL JOIN p ON lower(w.name) = lower(p.name) ORDER BY wins DESC, participations DESC, name LIMIT 8""",
)
def _(s, d):
    return activity.candidates(_par(s, d), _res(s, d), "supplier")


@query(
    "company_short_name",
    """SELECT count(*) FILTER (n_name || ' ' || r_name || ' ' || c_name ILIKE '% asia %') AS inner_hits,
    count(*) FILTER (n_name || ' ' || r_name ILIKE '% asia %') AS end_hits,
    count(*) FILTER (' ' || n_name || ' ' || r_name || ' ' ILIKE '% asia %') AS word_hits
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def _(s, d):
    named = (
        star.table(s, d, "customer")
        .join(star.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(star.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat_ws(" ", "n_name", "r_name", "c_name").alias("inner_name"), F.concat_ws(" ", "n_name", "r_name").alias("end_name"))
    )
    return named.agg(
        F.count_if(activity.short_name_match("inner_name", "asia")).alias("inner_hits"),
        F.count_if(activity.short_name_match("end_name", "asia")).alias("end_hits"),
        F.count_if(activity.short_name_match("end_name", "asia", whole_word=True)).alias("word_hits"),
    )


# --- containment index ------------------------------------------------------------------

_FIELDS = ("title", "buyer", "region")


def _indexed(s, d):
    landed = star.announcements(s, d)
    return landed, contains.write_index(landed, "procurement_id", _FIELDS, f"{shared_folder(s)}/{uuid.uuid4().hex}")


@query(
    "contains_words",
    """WITH words AS (SELECT DISTINCT 'title' AS field, substr(c_mktsegment, 2, 4) || '%' || CAST(o_orderkey % 1000 AS VARCHAR) AS word
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 100 = 0
      UNION SELECT 'buyer', lower(right(c_name, 3)) FROM customer WHERE c_custkey % 100 = 0
      UNION SELECT 'region', upper(left(n_name, 2)) FROM nation),
    texts AS (SELECT procurement_id, 'title' AS field, title AS text FROM ann UNION ALL SELECT procurement_id, 'buyer', buyer FROM ann
      UNION ALL SELECT procurement_id, 'region', region FROM ann)
    SELECT field, word, count(*) AS found, min(procurement_id) AS first_id, max(procurement_id) AS last_id
    FROM words JOIN texts USING (field) WHERE text ILIKE '%' || word || '%' GROUP BY ALL""",
)
def _(s, d):
    """Words of every hundredth order and customer, and of all nations, looked up in all announcements."""
    ordered = star.table(s, d, "orders").where(F.col("o_orderkey") % 100 == 0).join(star.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    parts = (
        ordered.select(F.lit("title").alias("field"), F.concat(F.substring("c_mktsegment", 2, 4), F.lit("%"), (F.col("o_orderkey") % 1000).cast("string")).alias("word")),
        star.table(s, d, "customer").where(F.col("c_custkey") % 100 == 0).select(F.lit("buyer"), F.lower(F.right(F.col("c_name"), F.lit(3)))),
        star.table(s, d, "nation").select(F.lit("region"), F.upper(F.left(F.col("n_name"), F.lit(2)))),
    )
    words = parts[0].union(parts[1]).union(parts[2]).distinct().withColumn("word_id", F.col("word"))
    landed, index = _indexed(s, d)
    found = contains.containing(words, landed, _FIELDS, index)
    return found.groupBy("field", F.col("word_id").alias("word")).agg(F.count(F.lit(1)).alias("found"), F.min("key").alias("first_id"), F.max("key").alias("last_id"))


@query(
    "search_indexed",
    """SELECT procurement_id, title, buyer FROM ann WHERE (title ILIKE '%machin%low%' OR title ILIKE '%99%') AND buyer ILIKE '%#0%1%'
    ORDER BY publication_date DESC NULLS FIRST, procurement_id LIMIT 50""",
)
def _(s, d):
    """A search page whose words meet the index first."""
    landed, index = _indexed(s, d)
    q = search.Query(TODAY, status="all", keywords=("machin%low", "99"), buyer="#0%1")
    return contains.indexed_search(landed, q, index).select("procurement_id", "title", "buyer")
