"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = expand(sql)
        return run

    return register


# Common table expressions of the SQL twins, in dependency order.
_TOWNS = (
    "['Rīga', 'Jūrmala, LV-2015', 'Cēsu novads, Cēsis', 'Liepāja', 'Jelgava', 'Daugavpils', 'Latvija', 'Balvu novads', "
    "'Brīvības iela 1, Salaspils', '-']"
)
PARTS = {
    "lines": """SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity, l_shipdate, l_returnflag, l_linestatus, l_tax,
        CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2))), 2)
             AS DECIMAL(18,2)) AS value FROM lineitem""",
    "sup": """SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'SIA "' || s_name || '"' ELSE s_name END AS name,
        upper(s_name) AS norm_name FROM supplier""",
    "offers": """SELECT l_orderkey, l_suppkey, sum(value) AS price, min(l_partkey) AS part, max(l_linenumber) AS lots
        FROM lines GROUP BY ALL""",
    "bids": """SELECT CAST(l_orderkey AS VARCHAR) AS procurement_id, l_suppkey AS pos, name, norm_name,
        CAST(l_suppkey AS VARCHAR) AS reg, CAST(price AS DECIMAL(18,2)) AS price FROM offers JOIN sup ON l_suppkey = s_suppkey""",
    "decided": """SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, min(price) AS award,
        arg_min(l_suppkey, (price, l_suppkey)) AS winner, min(part) AS part, max(lots) AS lots FROM offers GROUP BY ALL""",
    "mrows": """SELECT CAST(o_orderkey AS VARCHAR) AS procurement_id, CAST(year(o_orderdate) AS INTEGER) AS year,
        CAST(part % 90 + 10 AS VARCHAR) || '000000-' || CAST(part % 10 AS VARCHAR) AS cpv_main,
        c_name AS purchaser_name, upper(c_name) AS buyer_normalized, r_name AS planning_region, c_mktsegment AS category,
        n_name || ', ' || r_name AS delivery_location,
        CASE WHEN o_orderkey % 10 <> 9 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS estimate,
        w.name AS winner, w.norm_name AS winner_normalized, CAST(award AS DECIMAL(18,2)) AS award, n AS bidders,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'lowest_price' ELSE 'best_value' END AS evaluation_method,
        o_orderstatus AS procurement_status, strftime(o_orderdate, '%d.%m.%Y') AS bid_deadline,
        CASE WHEN o_orderstatus <> 'P' THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER), '%Y-%m-%d') END
          AS decision_date,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 40 AS INTEGER) END AS lag,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'EU-' || o_orderpriority END AS eu_project_reference,
        coalesce(lots >= 5, false) AS is_multi_lot,
        CASE WHEN o_orderkey % 3 <> 0 THEN lots END AS lot_count,
        CASE WHEN o_orderkey % 2 = 0 THEN 3 END AS json_lots
        FROM orders LEFT JOIN decided ON o_orderkey = l_orderkey LEFT JOIN sup w ON decided.winner = s_suppkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "facts": """SELECT b.*, r.year, r.buyer_normalized, r.category, r.award, b.norm_name IS NOT DISTINCT FROM r.winner_normalized AS won,
        CASE WHEN b.norm_name IS DISTINCT FROM r.winner_normalized AND r.award <> 0
          AND (CAST(b.price AS DOUBLE) - CAST(r.award AS DOUBLE)) / CAST(r.award AS DOUBLE) * 100.0 >= 0
          THEN (CAST(b.price AS DOUBLE) - CAST(r.award AS DOUBLE)) / CAST(r.award AS DOUBLE) * 100.0 END AS gap
        FROM bids b JOIN mrows r USING (procurement_id)""",
    "bidders": """SELECT max(name) AS name, count(*) AS applications, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses,
        round(count(*) FILTER (won) * 100.0 / count(*), 1) AS win_rate_pct,
        CAST(sum(price) AS DOUBLE) AS total_bid_value_eur, coalesce(CAST(sum(award) FILTER (won) AS DOUBLE), 0) AS won_value_eur,
        count(DISTINCT buyer_normalized) AS buyers_count,
        count(*) FILTER (gap <= 1) AS close_losses_1pct, count(*) FILTER (gap <= 3) AS close_losses_3pct,
        count(*) FILTER (gap <= 5) AS close_losses_5pct,
        round(CAST(sum(CAST(gap AS DECIMAL(24,6))) AS DOUBLE) / nullif(count(gap), 0), 2) AS avg_loss_gap_pct, norm_name
        FROM facts GROUP BY norm_name""",
    "favourite": """SELECT norm_name, arg_min(category, (-n, category)) AS top_category
        FROM (SELECT norm_name, category, count(*) AS n FROM facts GROUP BY ALL) GROUP BY ALL""",
    "board": """SELECT b.* EXCLUDE (norm_name), f.top_category FROM bidders b JOIN favourite f USING (norm_name)""",
    "flagged": """SELECT *, coalesce(bidders = 1, false) AS single, coalesce(bidders <= 2, false) AS low,
        coalesce(award <> 0 AND estimate <> 0, false) AS usable,
        coalesce(award <> 0 AND estimate <> 0 AND award > estimate, false) AS above,
        coalesce(award <> 0 AND estimate <> 0 AND award > estimate * 1.1, false) AS above10,
        coalesce(award <> 0 AND estimate <> 0 AND award < estimate * 0.8, false) AS below20 FROM mrows""",
    "pairs": """SELECT least(a.norm_name, b.norm_name) AS x, greatest(a.norm_name, b.norm_name) AS y, a.procurement_id,
        least(a.price, b.price) > 0 AND greatest(a.price, b.price) - least(a.price, b.price) <= least(a.price, b.price) * 0.03 AS near,
        r.evaluation_method = 'lowest_price' AS lowest
        FROM bids a JOIN bids b ON a.procurement_id = b.procurement_id AND a.pos < b.pos
        JOIN mrows r ON r.procurement_id = a.procurement_id""",
    "repeated": """SELECT x, y, count(*) FILTER (near) AS close, count(*) AS met, count(*) FILTER (near AND lowest) AS close_low
        FROM pairs GROUP BY ALL HAVING count(*) FILTER (near) >= 3 AND count(*) >= 3""",
    "risky": """SELECT f.*, p.procurement_id IS NOT NULL AS close_pair,
        single OR low OR above OR above10 OR p.procurement_id IS NOT NULL AS risky
        FROM flagged f LEFT JOIN (SELECT DISTINCT procurement_id FROM pairs JOIN repeated USING (x, y)) p USING (procurement_id)""",
    "ann": f"""SELECT CAST(o_orderkey AS VARCHAR) AS procurement_id,
        c_mktsegment || ' ' || o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS title, c_name AS buyer,
        '4' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS buyer_reg_number,
        CASE WHEN o_orderkey % 50 = 1 THEN '' WHEN o_orderkey % 50 <> 0
          THEN CAST(o_orderkey % 90 + 10 AS VARCHAR) || '000000-' || CAST(o_orderkey % 10 AS VARCHAR) END AS cpv_main,
        CASE o_orderstatus WHEN 'O' THEN 'Izsludināts' WHEN 'F' THEN 'Līgums noslēgts' ELSE 'Pārtraukts' END AS status,
        CASE WHEN o_orderkey % 40 <> 7 THEN strftime(o_orderdate, '%Y-%m-%d') END AS publication_date,
        CASE WHEN o_orderkey % 45 = 3 THEN '' WHEN o_orderkey % 45 <> 4
          THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER), '%d.%m.%Y') END AS submission_deadline,
        CASE WHEN o_orderkey % 45 NOT IN (3, 4) THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) END AS deadline,
        {_TOWNS}[c_nationkey % 10 + 1] AS region,
        CASE WHEN o_orderkey % 10 <> 9 THEN o_totalprice END AS estimated_value_eur, o_orderpriority AS procedure_type,
        ['Būvdarbi', 'Pakalpojums', 'Piegāde'][c_custkey % 3 + 1] AS subject_type,
        'https://portal.example/' || CAST(o_orderkey AS VARCHAR) AS eis_url,
        CASE o_orderkey % 3 WHEN 0 THEN 'Jā' WHEN 1 THEN 'Nē' END AS has_lots,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'lowest_price' ELSE 'best_value' END AS winner_selection_method
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "res": """SELECT CAST(l_orderkey AS VARCHAR) AS procurement_id, 'T' || CAST(l_orderkey AS VARCHAR) AS procurement_title,
        name AS winner_name, '4' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS winner_reg_number,
        CASE WHEN l_suppkey % 17 <> 0 THEN CAST(sum(value) AS DOUBLE) END AS contract_value_eur,
        CAST(min(value) AS DOUBLE) AS contract_value_original_eur,
        CASE WHEN l_suppkey % 2 = 0 THEN strftime(max(l_shipdate), '%Y-%m-%d') ELSE strftime(max(l_shipdate), '%d.%m.%Y') END AS contract_signed_date,
        max(CAST(l_shipdate AS DATE)) AS signed, CAST(year(max(l_shipdate)) AS INTEGER) AS source_year
        FROM lines JOIN sup ON l_suppkey = s_suppkey WHERE l_returnflag = 'A' GROUP BY l_orderkey, l_suppkey, name""",
    "par": """SELECT CAST(l_orderkey AS VARCHAR) AS procurement_id, name AS participant_name,
        '4' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS participant_reg_number,
        strftime(min(l_shipdate), '%Y-%m-%d') AS participant_submitted_at, CAST(year(min(l_shipdate)) AS INTEGER) AS source_year,
        l_orderkey FROM lines JOIN sup ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_suppkey, name""",
    "wide": """SELECT par.* EXCLUDE (l_orderkey), 'T' || procurement_id AS procurement_title,
        'Buyer ' || CAST(o_custkey AS VARCHAR) AS buyer,
        CAST(o_orderkey % 90 + 10 AS VARCHAR) || '000000-' || CAST(o_orderkey % 10 AS VARCHAR) AS cpv_main,
        CASE o_orderstatus WHEN 'O' THEN 'Izsludināts' WHEN 'F' THEN 'Līgums noslēgts' ELSE 'Pārtraukts' END AS status,
        CASE WHEN o_orderkey % 45 = 3 THEN '' WHEN o_orderkey % 45 <> 4
          THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER), '%d.%m.%Y') END AS submission_deadline,
        o_totalprice AS estimated_value_eur FROM par JOIN orders ON l_orderkey = o_orderkey""",
}


def expand(sql: str) -> str:
    """Prepend the common table expressions the statement mentions."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in PARTS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(body)
    parts = ", ".join(f"{n} AS ({b})" for n, b in PARTS.items() if n in needed)
    body = sql.strip()
    if not parts:
        return body
    return f"WITH {parts}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {parts} {body}"
