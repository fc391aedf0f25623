"""Dashboard, company, purchaser and risk queries over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.facts import AWARD, COUNT, ESTIMATE, bid_facts
from ..plans import company, dashboard, purchaser, risk
from ..sources import star
from .registry import query


def _rows(s, d):
    return star.market_rows(s, d)


def _bids(s, d):
    return star.bids(s, d)


# --- dashboard --------------------------------------------------------------


@query(
    "dash_overview",
    """SELECT count(*) AS projects_in_scope, CAST(sum(coalesce(award, 0)) AS DOUBLE) AS total_awarded_sum_eur,
    CAST(sum(coalesce(estimate, 0)) AS DOUBLE) AS total_estimated_sum_eur, count(award) AS awarded_projects_count,
    count(estimate) AS estimated_projects_count, count(DISTINCT winner_normalized) AS winners_count,
    count(*) FILTER (is_multi_lot) AS multi_lot_projects_count,
    round(count(*) FILTER (is_multi_lot) * 100.0 / count(*), 1) AS multi_lot_share_pct,
    round(sum(coalesce(bidders, 0)) / count(*), 2) AS average_bidders,
    round(count(*) FILTER (bidders = 1) * 100.0 / count(*), 1) AS single_bidder_share_pct,
    count(DISTINCT buyer_normalized) AS buyers_count, count(DISTINCT planning_region) AS regions_count FROM mrows""",
)
def _(s, d):
    return dashboard.overview(_rows(s, d))


@query(
    "dash_years",
    """SELECT year, count(*) AS projects, CAST(sum(coalesce(award, 0)) AS DOUBLE) AS awarded_sum_eur,
    CAST(sum(coalesce(estimate, 0)) AS DOUBLE) AS estimated_sum_eur, count(*) FILTER (is_multi_lot) AS multi_lot_projects,
    round(count(*) FILTER (is_multi_lot) * 100.0 / count(*), 1) AS multi_lot_share_pct FROM mrows GROUP BY year""",
)
def _(s, d):
    return dashboard.yearly_series(_rows(s, d))


_RANK = """SELECT {col} AS name, count(*) AS project_count, CAST(sum(coalesce(award, 0)) AS DOUBLE) AS awarded_sum_eur
    FROM mrows {where} GROUP BY 1 ORDER BY awarded_sum_eur DESC, project_count DESC, name {limit}"""
for _dim, _col, _where, _limit in (
    ("winner", "winner_normalized", "WHERE winner IS NOT NULL", "LIMIT 10"),
    ("buyer", "buyer_normalized", "", "LIMIT 10"),
    ("region", "planning_region", "", "LIMIT 10"),
    ("category", "category", "", ""),
    ("cpv", "coalesce(cpv_main, 'Nav norādīts')", "", "LIMIT 15"),
):
    query(f"dash_rank_{_dim}", _RANK.format(col=_col, where=_where, limit=_limit))(
        lambda s, d, _dim=_dim: dashboard.ranking(_rows(s, d), _dim)
    )


def _scoped_categories(s, d):
    """Segments renamed to the category words the summary groups by."""
    words = {"AUTOMOBILE": "design", "BUILDING": "construction_new", "FURNITURE": "maintenance", "MACHINERY": "design_build"}
    renamed = F.col("category")
    for segment, word in words.items():
        renamed = F.when(F.col("category") == segment, word).otherwise(renamed)
    return _rows(s, d).withColumn("category", renamed)


@query(
    "dash_category_summary",
    """SELECT g.name, count(m.award_or_zero) AS project_count, coalesce(CAST(sum(m.award_or_zero) AS DOUBLE), 0) AS awarded_sum_eur
    FROM (VALUES ('design'), ('build'), ('design_build')) g(name) LEFT JOIN
    (SELECT CASE category WHEN 'AUTOMOBILE' THEN 'design' WHEN 'BUILDING' THEN 'build' WHEN 'FURNITURE' THEN 'build'
     WHEN 'MACHINERY' THEN 'design_build' END AS name, coalesce(award, 0) AS award_or_zero FROM mrows) m USING (name) GROUP BY g.name""",
)
def _(s, d):
    return dashboard.category_summary(_scoped_categories(s, d))


@query(
    "dash_concentration",
    """WITH paid AS (SELECT winner_normalized, sum(coalesce(award, 0)) AS won FROM mrows WHERE winner IS NOT NULL GROUP BY 1),
    t AS (SELECT CAST(sum(coalesce(award, 0)) AS DOUBLE) AS grand FROM mrows),
    b AS (SELECT CAST(sum(won) AS DOUBLE) AS best FROM (SELECT won FROM paid ORDER BY won DESC, winner_normalized LIMIT 5)),
    q AS (SELECT sum(CAST(won AS DOUBLE) * CAST(won AS DOUBLE)) FILTER (won > 0) AS squares FROM paid)
    SELECT round(best * 100.0 / grand, 1) AS top5_awarded_share_pct, round(squares * 10000.0 / (grand * grand), 1) AS hhi FROM t, b, q""",
)
def _(s, d):
    return dashboard.concentration(_rows(s, d))


@query(
    "bid_facts",
    """SELECT procurement_id, norm_name, name, CAST(price AS DOUBLE) AS price, won, round(gap, 4) AS gap_pct FROM facts""",
)
def _(s, d):
    facts = bid_facts(_rows(s, d), _bids(s, d))
    return facts.select(
        "procurement_id", "norm_name", "name", F.col("price").cast("double").alias("price"), "won", F.round("gap", 4).alias("gap_pct")
    )


def _board(s, d):
    return dashboard.bidder_table(_rows(s, d), _bids(s, d))


@query("bidder_leaderboard", "SELECT * FROM board ORDER BY applications DESC, wins DESC, name LIMIT 15")
def _(s, d):
    return dashboard.bidder_leaderboard(_board(s, d))


@query(
    "bidder_losers",
    "SELECT * FROM board WHERE wins = 0 AND applications >= 5 ORDER BY applications DESC, wins DESC, name LIMIT 10",
)
def _(s, d):
    return dashboard.bidder_losers(_board(s, d))


@query(
    "bidder_winners_rate",
    "SELECT * FROM board WHERE wins >= 3 ORDER BY win_rate_pct DESC, wins DESC, won_value_eur DESC, name LIMIT 10",
)
def _(s, d):
    return dashboard.bidder_winners_by_rate(_board(s, d))


@query(
    "bidder_winners_value",
    "SELECT * FROM board WHERE wins >= 1 ORDER BY won_value_eur DESC, wins DESC, win_rate_pct DESC, name LIMIT 10",
)
def _(s, d):
    return dashboard.bidder_winners_by_value(_board(s, d))


@query(
    "close_losses",
    """SELECT * FROM board WHERE close_losses_3pct > 0 ORDER BY close_losses_3pct DESC, applications DESC,
    coalesce(nullif(avg_loss_gap_pct, 0), 9999), name LIMIT 10""",
)
def _(s, d):
    return dashboard.close_losses(_board(s, d))


@query(
    "buyer_concentration",
    """WITH cells AS (SELECT buyer_normalized AS name, winner_normalized AS w, count(*) AS n, sum(coalesce(award, 0)) AS v
    FROM mrows WHERE winner IS NOT NULL GROUP BY ALL),
    b AS (SELECT name, sum(n) AS n, sum(v) AS v, arg_min(w, (-n, w)) AS w, arg_min(n, (-n, w)) AS wn, arg_min(v, (-n, w)) AS wv
      FROM cells GROUP BY name HAVING sum(n) >= 5)
    SELECT name, CAST(n AS BIGINT) AS project_count, CAST(v AS DOUBLE) AS awarded_sum_eur, w AS top_winner, wn AS top_winner_projects,
    round(wn * 100.0 / CAST(n AS DOUBLE), 1) AS top_winner_share_pct,
    round(CAST(wv AS DOUBLE) * 100.0 / CAST(v AS DOUBLE), 1) AS top_winner_amount_share_pct
    FROM b ORDER BY top_winner_share_pct DESC, project_count DESC, name LIMIT 10""",
)
def _(s, d):
    return dashboard.buyer_concentration(_rows(s, d))


@query(
    "multi_lot",
    """SELECT count(*) FILTER (is_multi_lot) AS projects, round(count(*) FILTER (is_multi_lot) * 100.0 / count(*), 1) AS share_pct,
    CAST(sum(coalesce(lot_count, json_lots, 0)) FILTER (is_multi_lot) AS BIGINT) AS known_total_lots,
    round(CAST(sum(coalesce(lot_count, json_lots, 0)) FILTER (is_multi_lot) AS DOUBLE) / count(*) FILTER (is_multi_lot), 2)
      AS average_lots_per_multi_lot_project FROM mrows""",
)
def _(s, d):
    return dashboard.multi_lot(_rows(s, d))


_QUALITY = {
    "winner": ("Uzvarētājs", "winner IS NULL"),
    "award_amount": ("Līgumcena", "award IS NULL"),
    "estimated_value": ("Paredzamā cena", "estimate IS NULL"),
    "delivery_location": ("Vieta", "delivery_location IS NULL"),
    "bid_deadline": ("Piedāvājumu termiņš", "bid_deadline IS NULL"),
    "decision_date": ("Lēmuma datums", "decision_date IS NULL"),
    "participants": ("Dalībnieku skaits", "bidders IS NULL"),
    "eu_project_reference": ("ES projekta atsauce", "eu_project_reference IS NULL"),
}


@query(
    "data_quality",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS field, '{label}' AS label, count(*) FILTER ({x}) AS missing_count,
        round(100.0 - count(*) FILTER ({x}) * 100.0 / CAST(count(*) AS DOUBLE), 1) AS coverage_pct FROM mrows"""
        for f, (label, x) in _QUALITY.items()
    ),
)
def _(s, d):
    return dashboard.data_quality(_rows(s, d))


@query(
    "project_page",
    """SELECT procurement_id, year, purchaser_name, planning_region, category, cpv_main, procurement_status, winner,
    CAST(award AS DOUBLE) AS awarded_sum_eur, CAST(estimate AS DOUBLE) AS estimated_sum_eur, bidders AS participants_count,
    is_multi_lot, lot_count, 50 AS "limit", 100 AS "offset" FROM mrows ORDER BY year DESC, procurement_id DESC LIMIT 50 OFFSET 100""",
)
def _(s, d):
    page = dashboard.project_page(_rows(s, d), 50, 100)
    return page.withColumns({x: F.col(x).cast("double") for x in ("awarded_sum_eur", "estimated_sum_eur")})


@query("project_total", "SELECT count(*) AS total FROM mrows")
def _(s, d):
    return dashboard.project_total(_rows(s, d))


@query(
    "available_filters",
    """SELECT 'year' AS kind, CAST(year AS VARCHAR) AS value FROM mrows GROUP BY ALL
    UNION ALL SELECT 'buyer', purchaser_name FROM mrows GROUP BY ALL
    UNION ALL SELECT 'planning_region', planning_region FROM mrows GROUP BY ALL
    UNION ALL SELECT 'category', category FROM mrows GROUP BY ALL""",
)
def _(s, d):
    return dashboard.available_filters(_rows(s, d))


# --- company ----------------------------------------------------------------

CHOSEN = ["Supplier#000000001", "Supplier#000000003"]
_OURS = """sel AS (SELECT upper(x) AS norm_name FROM (VALUES ('Supplier#000000001'), ('Supplier#000000003')) t(x)),
    mine AS (SELECT procurement_id, min(price) AS ours FROM bids WHERE norm_name IN (SELECT norm_name FROM sel) GROUP BY 1),
    field AS (SELECT procurement_id, any_value(ours) AS ours, count(*) AS bidders, count(price) AS priced,
      min(price) FILTER (price > ours) AS nxt FROM bids JOIN mine USING (procurement_id) GROUP BY 1),
    our AS (SELECT r.*, f.ours, f.bidders AS listed, coalesce(r.winner_normalized IN (SELECT norm_name FROM sel), false) AS won,
      CASE WHEN NOT coalesce(r.winner_normalized IN (SELECT norm_name FROM sel), false) AND r.award <> 0
        AND CAST(f.ours AS DOUBLE) >= CAST(r.award AS DOUBLE)
        THEN (CAST(f.ours AS DOUBLE) - CAST(r.award AS DOUBLE)) / CAST(r.award AS DOUBLE) * 100.0 END AS lgap,
      CASE WHEN coalesce(r.winner_normalized IN (SELECT norm_name FROM sel), false) AND priced >= 2 AND f.ours <> 0
        THEN (CAST(nxt AS DOUBLE) - CAST(f.ours AS DOUBLE)) / CAST(f.ours AS DOUBLE) * 100.0 END AS margin,
      CASE WHEN estimate IS NULL THEN 'Nav paredzamās cenas' WHEN estimate < 100000 THEN 'Līdz 100k' WHEN estimate < 500000
        THEN '100k-500k' WHEN estimate < 1000000 THEN '500k-1M' WHEN estimate < 5000000 THEN '1M-5M' ELSE '5M+' END AS size_band
      FROM mrows r JOIN field f USING (procurement_id))"""


def _ours(s, d):
    bids = _bids(s, d)
    chosen = company.selection(s, bids, CHOSEN)
    return company.company_rows(_rows(s, d), bids, chosen), bids, chosen


@query("company_options", "SELECT DISTINCT name FROM bids")
def _(s, d):
    return company.options(_bids(s, d))


_MEAN = "round(CAST(sum(CAST({x} AS DECIMAL(24,6))) AS DOUBLE) / nullif(count({x}), 0), 2)"


@query(
    "company_summary",
    f"""WITH {_OURS} SELECT count(*) AS applications, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses,
    round(count(*) FILTER (won) * 100.0 / count(*), 1) AS win_rate_pct,
    coalesce(CAST(sum(coalesce(award, 0)) FILTER (won) AS DOUBLE), 0) AS won_value_eur,
    {_MEAN.format(x='lgap')} AS avg_losing_gap_pct, {_MEAN.format(x='margin')} AS avg_winning_margin_pct,
    count(*) FILTER (lgap <= 3) AS close_losses_3pct, count(DISTINCT buyer_normalized) AS buyers_count,
    count(DISTINCT category) AS categories_count FROM our""",
)
def _(s, d):
    return company.summary(_ours(s, d)[0])


_FIT = """WITH {ours}, c AS ({counts}) SELECT label, name, count FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY count DESC, name)
    AS k FROM c) WHERE k <= 10"""


@query(
    "company_fit",
    _FIT.format(
        ours=_OURS,
        counts=" UNION ALL ".join(
            f"SELECT '{label}' AS label, {col} AS name, count(*) AS count FROM our WHERE {col} IS NOT NULL GROUP BY ALL"
            for label, col in (
                ("buyer", "buyer_normalized"), ("category", "category"), ("region", "planning_region"), ("cpv", "cpv_main"),
                ("size_band", "size_band"),
            )
        ),
    ),
)
def _(s, d):
    return company.fit(_ours(s, d)[0])


@query(
    "company_segments",
    f"""WITH {_OURS} SELECT category, planning_region AS region, cpv_main AS cpv, count(*) AS bids, count(*) FILTER (won) AS wins,
    round(count(*) FILTER (won) * 100.0 / count(*), 1) AS win_rate_pct,
    round(CAST(sum(listed - 1) AS DOUBLE) / count(*), 2) AS avg_competitors FROM our GROUP BY 1, 2, 3 HAVING count(*) >= 2
    ORDER BY win_rate_pct DESC, coalesce(nullif(avg_competitors, 0), 999), bids DESC, 1, 2, 3 LIMIT 10""",
)
def _(s, d):
    return company.segments(_ours(s, d)[0])


@query(
    "company_rivals",
    f"""WITH {_OURS}, met AS (SELECT b.name, o.won AS we, NOT o.won AND b.norm_name = o.winner_normalized AS they,
      CASE WHEN o.won AND o.ours <> 0 THEN (CAST(b.price AS DOUBLE) - CAST(o.ours AS DOUBLE)) / CAST(o.ours AS DOUBLE) * 100.0
        WHEN b.norm_name = o.winner_normalized AND o.award <> 0
        THEN (CAST(o.ours AS DOUBLE) - CAST(o.award AS DOUBLE)) / CAST(o.award AS DOUBLE) * 100.0 END AS gap
      FROM bids b JOIN our o USING (procurement_id) WHERE b.norm_name NOT IN (SELECT norm_name FROM sel)),
    t AS (SELECT name, count(*) AS meet_count, count(*) FILTER (they) AS beat_us, count(*) FILTER (we) AS we_beat,
      {_MEAN.format(x='gap')} AS avg_gap_pct FROM met GROUP BY name)
    (SELECT *, 'met_most' AS ranking FROM t ORDER BY meet_count DESC, name LIMIT 10)
    UNION ALL (SELECT *, 'beat_us' FROM t ORDER BY beat_us DESC, meet_count DESC, name LIMIT 10)
    UNION ALL (SELECT *, 'we_beat' FROM t ORDER BY we_beat DESC, meet_count DESC, name LIMIT 10)""",
)
def _(s, d):
    ours, bids, chosen = _ours(s, d)
    return company.rival_rankings(company.rivals(ours, bids, chosen))


@query(
    "company_buyers",
    f"""WITH {_OURS}, cells AS (SELECT buyer_normalized AS name, winner_normalized AS w, count(*) AS n FROM mrows
      WHERE winner IS NOT NULL GROUP BY ALL),
    conc AS (SELECT name, round(max(n) * 100.0 / CAST(sum(n) AS DOUBLE), 1) AS market_concentration_pct FROM cells GROUP BY 1 HAVING sum(n) >= 5),
    t AS (SELECT buyer_normalized AS name, count(*) AS bids, count(*) FILTER (won) AS wins,
      round(count(*) FILTER (won) * 100.0 / count(*), 1) AS win_rate_pct,
      coalesce(CAST(sum(coalesce(award, 0)) FILTER (won) AS DOUBLE), 0) AS won_value_eur FROM our GROUP BY 1 HAVING count(*) >= 2),
    j AS (SELECT t.*, market_concentration_pct FROM t LEFT JOIN conc USING (name))
    (SELECT *, 'best' AS ranking FROM j ORDER BY win_rate_pct DESC, wins DESC, name LIMIT 10)
    UNION ALL (SELECT *, 'targets' FROM j ORDER BY coalesce(market_concentration_pct, 999), bids DESC, name LIMIT 10)""",
)
def _(s, d):
    ours, _bids_, _chosen = _ours(s, d)
    return company.buyer_rankings(company.buyers(ours, _rows(s, d)))


@query(
    "company_label",
    """SELECT 'Supplier#000000001 · Supplier#000000003' || coalesce(' · ' || string_agg(name, ' · ' ORDER BY name), '') AS selected_company
    FROM (SELECT DISTINCT name FROM bids WHERE norm_name IN ('SUPPLIER#000000001', 'SUPPLIER#000000003')
      AND name NOT IN ('Supplier#000000001', 'Supplier#000000003'))""",
)
def _(s, d):
    bids = _bids(s, d)
    return company.label(bids, company.selection(s, bids, CHOSEN))


# --- purchaser --------------------------------------------------------------

BUYER = "Customer#000000007"
_MINE = f"""mine AS (SELECT r.*, l.listed, coalesce(l.listed, r.bidders) AS known FROM mrows r LEFT JOIN
    (SELECT procurement_id, count(*) AS listed FROM bids GROUP BY 1) l USING (procurement_id) WHERE purchaser_name = '{BUYER}'),
    sups AS (SELECT winner AS name, count(*) AS project_count, CAST(sum(coalesce(award, 0)) AS DOUBLE) AS awarded_sum_eur,
      round(count(*) * 100.0 / (SELECT count(*) FROM mine), 1) AS win_share_pct FROM mine WHERE winner IS NOT NULL GROUP BY 1)"""


def _mine(s, d):
    bids = _bids(s, d)
    return purchaser.purchaser_rows(_rows(s, d), bids, BUYER), bids


@query("purchaser_options", "SELECT DISTINCT c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey")
def _(s, d):
    return purchaser.options(_rows(s, d))


@query(
    "purchaser_summary",
    f"""WITH {_MINE} SELECT count(*) AS projects, CAST(sum(coalesce(award, 0)) AS DOUBLE) AS awarded_sum_eur,
    CAST(sum(coalesce(estimate, 0)) AS DOUBLE) AS estimated_sum_eur, count(DISTINCT winner) AS suppliers_count,
    round(CAST(sum(known) AS DOUBLE) / count(known), 2) AS avg_competitors,
    round(count(*) FILTER (known = 1) * 100.0 / count(known), 1) AS single_bidder_share_pct,
    round(CAST(sum(lag) AS DOUBLE) / count(lag), 1) AS avg_decision_lag_days,
    round((SELECT project_count FROM sups ORDER BY awarded_sum_eur DESC, project_count DESC, name LIMIT 1) * 100.0 / count(*), 1)
      AS top_supplier_share_pct FROM mine""",
)
def _(s, d):
    return purchaser.summary(_mine(s, d)[0])


@query(
    "purchaser_fit",
    _FIT.format(
        ours=_MINE,
        counts=" UNION ALL ".join(
            f"SELECT '{label}' AS label, CAST({col} AS VARCHAR) AS name, count(*) AS count FROM mine GROUP BY ALL"
            for label, col in (
                ("category", "category"), ("region", "planning_region"), ("cpv", "coalesce(cpv_main, 'Nav norādīts')"), ("year", "year"),
                ("evaluation_method", "evaluation_method"),
            )
        ),
    ),
)
def _(s, d):
    return purchaser.fit(_mine(s, d)[0])


@query(
    "purchaser_suppliers",
    f"WITH {_MINE} SELECT * FROM sups ORDER BY awarded_sum_eur DESC, project_count DESC, name LIMIT 10",
)
def _(s, d):
    return purchaser.suppliers(_mine(s, d)[0])


@query(
    "purchaser_bidders",
    f"""WITH {_MINE}, a AS (SELECT name, count(*) AS project_count FROM bids WHERE procurement_id IN (SELECT procurement_id FROM mine) GROUP BY 1)
    SELECT a.name, a.project_count, coalesce(awarded_sum_eur, 0) AS awarded_sum_eur, coalesce(sups.project_count, 0) AS win_count,
    round(coalesce(sups.project_count, 0) * 100.0 / a.project_count, 1) AS win_rate_pct FROM a LEFT JOIN sups ON sups.name = a.name
    ORDER BY a.project_count DESC, win_count DESC, a.name LIMIT 10""",
)
def _(s, d):
    return purchaser.frequent_bidders(*_mine(s, d))


@query(
    "purchaser_segments",
    f"""WITH {_MINE}, g AS (SELECT category, planning_region AS region, coalesce(cpv_main, 'Nav norādīts') AS cpv, count(*) AS projects,
      CAST(sum(coalesce(award, 0)) AS DOUBLE) AS awarded_sum_eur,
      round(CAST(sum(coalesce(listed, 0)) AS DOUBLE) / count(*), 2) AS avg_competitors,
      round(count(*) FILTER (listed = 1) * 100.0 / count(*), 1) AS single_bidder_share_pct FROM mine GROUP BY 1, 2, 3)
    (SELECT *, 'biggest' AS ranking FROM g ORDER BY awarded_sum_eur DESC, projects DESC, category, region, cpv LIMIT 10)
    UNION ALL (SELECT *, 'open' FROM g WHERE projects >= 2
      ORDER BY single_bidder_share_pct, avg_competitors, projects DESC, category, region, cpv LIMIT 10)""",
)
def _(s, d):
    return purchaser.segment_rankings(purchaser.segments(_mine(s, d)[0]))


@query(
    "purchaser_context",
    f"""WITH {_MINE}, dom AS (
      (SELECT 'region' AS scope, planning_region AS value FROM mine GROUP BY 2 ORDER BY count(*) DESC, value LIMIT 1)
      UNION ALL (SELECT 'category', category FROM mine GROUP BY 2 ORDER BY count(*) DESC, category LIMIT 1)),
    cells AS (SELECT 'region' AS scope, planning_region AS value, purchaser_name, winner, coalesce(award, 0) AS a FROM mrows
      UNION ALL SELECT 'category', category, purchaser_name, winner, coalesce(award, 0) FROM mrows),
    sides AS (SELECT scope, value, 'purchasers' AS side, purchaser_name AS name, a FROM cells JOIN dom USING (scope, value)
      UNION ALL SELECT scope, value, 'companies', winner, a FROM cells JOIN dom USING (scope, value) WHERE winner IS NOT NULL),
    t AS (SELECT scope, value, side, name, CAST(sum(a) AS DOUBLE) AS awarded_sum_eur FROM sides GROUP BY ALL)
    SELECT *, side = 'purchasers' AND name = '{BUYER}' AS is_selected FROM t
    QUALIFY row_number() OVER (PARTITION BY scope, side ORDER BY awarded_sum_eur DESC, name) <= 10""",
)
def _(s, d):
    return purchaser.market_context(_rows(s, d), _mine(s, d)[0])


@query(
    "purchaser_dominant",
    f"""WITH {_MINE} SELECT (SELECT planning_region FROM mine GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_region,
    (SELECT category FROM mine GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_category""",
)
def _(s, d):
    return purchaser.dominant(_mine(s, d)[0])


# --- risk -------------------------------------------------------------------


def _priced(s, d):
    return risk.priced_bids(star.evaluation_methods(s, d), _bids(s, d))


@query(
    "risk_pairs",
    """SELECT x || ' · ' || y AS name, close AS close_bid_count, met AS meet_count, close_low AS lowest_price_close_count,
    round(close * 100.0 / met, 1) AS close_share_pct FROM repeated ORDER BY close DESC, met DESC, name LIMIT 15""",
)
def risk_pairs(s, d):
    return risk.repeated_pairs(_priced(s, d))


@query(
    "risk_pairs_repeated",
    """WITH l AS (SELECT l_orderkey AS p, row_number() OVER (ORDER BY l_orderkey, l_suppkey, l_partkey, l_linenumber, value) AS pos, 'N' || l_suppkey % 40 AS name,
      CAST(100 + l_quantity AS DECIMAL(18,2)) AS price FROM lines),
    m AS (SELECT least(a.name, b.name) AS a, greatest(a.name, b.name) AS b FROM l a JOIN l b ON a.p = b.p AND a.pos < b.pos
      AND greatest(a.price, b.price) - least(a.price, b.price) <= least(a.price, b.price) * 0.03)
    SELECT a, b, count(*) AS close FROM m GROUP BY ALL HAVING count(*) >= 3""",
)
def _(s, d):
    """Close pairs where a procurement may list one bidder several times: lines as bids of forty names."""
    line = star.lines(s, d)
    bids = line.select(
        F.col("l_orderkey").cast("string").alias("procurement_id"), F.struct("l_suppkey", "l_partkey", "l_linenumber", "value").alias("pos"),
        F.concat(F.lit("N"), (F.col("l_suppkey") % 40).cast("string")).alias("norm_name"), (F.col("l_quantity") + 100).cast("decimal(18,2)").alias("price"), F.lit(False).alias("lowest"),
    )
    return risk.close_pair_counts(bids).select("a", "b", "close")


@query(
    "risk_pairs_all",
    """SELECT x || ' · ' || y AS name, close AS close_bid_count, met AS meet_count, close_low AS lowest_price_close_count,
    round(close * 100.0 / met, 1) AS close_share_pct FROM repeated""",
)
def _(s, d):
    return risk.repeated_pairs(_priced(s, d), None)


def _flagged(s, d):
    return risk.risk_rows(_rows(s, d), _priced(s, d))


@query(
    "risk_rows",
    """SELECT procurement_id, single AS single_bidder, low AS low_competition, above AS above_estimate, above10 AS above_estimate_10pct,
    below20 AS below_estimate_20pct, close_pair, risky FROM risky""",
)
def _(s, d):
    return _flagged(s, d).select(
        "procurement_id", "single_bidder", "low_competition", "above_estimate", "above_estimate_10pct", "below_estimate_20pct",
        "close_pair", "risky",
    )


@query(
    "risk_summary",
    """SELECT count(*) AS projects, count(*) FILTER (usable) AS with_estimate_count, """
    + ", ".join(
        f"count(*) FILTER ({f}) AS {n}_count, round(count(*) FILTER ({f}) * 100.0 / {b}, 1) AS {n}_share_pct"
        for n, f, b in (
            ("single_bidder", "single", "count(*)"), ("low_competition", "low", "count(*)"),
            ("award_above_estimate", "above", "count(*) FILTER (usable)"),
            ("award_above_estimate_10pct", "above10", "count(*) FILTER (usable)"),
            ("award_below_estimate_20pct", "below20", "count(*) FILTER (usable)"),
        )
    )
    + " FROM risky",
)
def _(s, d):
    return risk.summary(risk.flagged_rows(_rows(s, d)))


@query(
    "risk_hotspots",
    "WITH t AS ("
    + " UNION ALL ".join(
        f"""SELECT '{k}' AS kind, {c} AS name, count(*) AS project_count, count(*) FILTER (risky) AS risky_project_count,
        round(count(*) FILTER (risky) * 100.0 / count(*), 1) AS risky_project_share_pct, count(*) FILTER (single) AS single_bidder_count,
        count(*) FILTER (above) AS above_estimate_count, CAST(sum(coalesce(award, 0)) AS DOUBLE) AS awarded_sum_eur
        FROM risky GROUP BY ALL HAVING count(*) >= 5"""
        for k, c in (("buyer", "purchaser_name"), ("region", "planning_region"), ("category", "category"))
    )
    + """) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY kind ORDER BY risky_project_share_pct DESC, risky_project_count DESC,
    awarded_sum_eur DESC, name) <= 10""",
)
def _(s, d):
    return risk.hotspots(_flagged(s, d))


@query(
    "risk_winners",
    """SELECT winner AS name, count(*) AS project_count, count(*) FILTER (risky) AS risky_project_count,
    round(count(*) FILTER (risky) * 100.0 / count(*), 1) AS risky_project_share_pct,
    CAST(sum(coalesce(award, 0)) AS DOUBLE) AS awarded_sum_eur,
    coalesce(CAST(sum(coalesce(award, 0)) FILTER (risky) AS DOUBLE), 0) AS risky_awarded_sum_eur,
    count(*) FILTER (single) AS single_bidder_wins, count(*) FILTER (above) AS above_estimate_wins
    FROM risky WHERE winner IS NOT NULL GROUP BY winner HAVING count(*) >= 3
    ORDER BY risky_project_share_pct DESC, risky_project_count DESC, awarded_sum_eur DESC, name LIMIT 10""",
)
def _(s, d):
    return risk.risky_winners(_flagged(s, d))


@query(
    "risk_single_buyer",
    """SELECT purchaser_name AS name, count(*) AS project_count, count(*) FILTER (bidders = 1) AS single_bidder_count,
    CAST(sum(coalesce(award, 0)) AS DOUBLE) AS awarded_sum_eur,
    round(count(*) FILTER (bidders = 1) * 100.0 / count(*), 1) AS single_bidder_share_pct
    FROM mrows WHERE bidders IS NOT NULL GROUP BY 1 HAVING count(*) >= 5
    ORDER BY single_bidder_share_pct DESC, project_count DESC, name LIMIT 10""",
)
def _(s, d):
    return risk.single_bidder_buyers(_rows(s, d))


@query(
    "risk_buyer_concentration",
    """WITH cells AS (SELECT purchaser_name AS name, winner_normalized AS w, count(*) AS n, sum(coalesce(award, 0)) AS v FROM mrows GROUP BY ALL),
    b AS (SELECT name, sum(n) FILTER (w IS NOT NULL) AS n, sum(v) AS v, arg_min(w, (-n, w)) FILTER (w IS NOT NULL) AS w,
      max(n) FILTER (w IS NOT NULL) AS wn FROM cells GROUP BY 1)
    SELECT name, CAST(n AS BIGINT) AS project_count, w AS top_winner, wn AS top_winner_projects, CAST(v AS DOUBLE) AS awarded_sum_eur,
    round(wn * 100.0 / CAST(n AS DOUBLE), 1) AS top_winner_share_pct FROM b WHERE n >= 5
    ORDER BY top_winner_share_pct DESC, project_count DESC, name LIMIT 10""",
)
def _(s, d):
    return risk.buyer_concentration(_rows(s, d))
