"""Cell-cleaning, name, place and label queries over whole star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as c
from ..functions import fixed, jsonlists, labels, names
from ..operators import facts
from ..sources import star
from .registry import query


def _cases(index, *values):
    """Value by position of ``index``; the last one serves all higher positions."""
    out = F.when(index == 0, values[0])
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(index == i, v)
    return out.otherwise(values[-1])


def _orders(s, d):
    return star.table(s, d, "orders")


@query(
    "clean_excel",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % 5 AS i FROM orders)
    SELECT o_orderkey, CASE i WHEN 1 THEN ' =''' || k || ''' ' WHEN 4 THEN '' ELSE k END AS loose,
    CASE i WHEN 1 THEN '=''' || k || '''' WHEN 3 THEN '="' || k WHEN 4 THEN NULL ELSE k END AS strict,
    CASE i WHEN 3 THEN '="' || k WHEN 4 THEN NULL ELSE k END AS cell FROM o""",
)
def _(s, d):
    k = F.col("o_orderkey").cast("string")
    raw = _cases(
        F.col("o_orderkey") % 5, F.concat(F.lit('="'), k, F.lit('"')), F.concat(F.lit(" ='"), k, F.lit("' ")), k, F.concat(F.lit('="'), k),
        F.lit(None).cast("string"),
    )
    staged = _orders(s, d).select("o_orderkey", raw.alias("raw"))
    x = F.col("raw")
    return staged.select("o_orderkey", c.unwrap_loose(x).alias("loose"), c.unwrap_strict(x).alias("strict"), c.clean_cell(x).alias("cell"))


@query(
    "parse_numbers",
    """WITH l AS (SELECT l_orderkey, l_partkey, CAST(l_quantity AS INTEGER) AS q, l_partkey % 6 AS i, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT i AS form, CAST(sum(CASE i WHEN 0 THEN q WHEN 1 THEN q + 0.5 WHEN 3 THEN q + 0.25 END * n) AS DOUBLE) AS comma_sum,
    CAST(sum(CASE i WHEN 0 THEN q WHEN 1 THEN q + 0.5 WHEN 2 THEN 1000 + q + 0.5 WHEN 3 THEN q + 0.25 END * n) AS DOUBLE) AS spaced_sum,
    CAST(sum(CASE i WHEN 0 THEN q WHEN 3 THEN q + 0.25 END * n) AS DOUBLE) AS plain_sum,
    CAST(sum(CASE i WHEN 0 THEN q END * n) AS BIGINT) AS whole_sum, CAST(sum(CASE i WHEN 0 THEN q WHEN 3 THEN q END * n) AS BIGINT) AS truncated_sum,
    max(CASE i WHEN 0 THEN CAST(q AS VARCHAR) || '.00' WHEN 1 THEN CAST(q AS VARCHAR) || ',5' WHEN 2 THEN '1 0' || lpad(CAST(q AS VARCHAR), 2, '0')
      || ',50' WHEN 3 THEN CAST(q AS VARCHAR) || '.25' WHEN 4 THEN CAST(q AS VARCHAR) || 'd' END) AS last_money FROM l GROUP BY i""",
)
def _(s, d):
    q = F.col("l_quantity").cast("int").cast("string")
    raw = _cases(
        F.col("l_partkey") % 6, q, F.concat(q, F.lit(",5")), F.concat(F.lit("1 0"), F.lpad(q, 2, "0"), F.lit(",50")), F.concat(q, F.lit(".25")),
        F.concat(q, F.lit("d")), F.lit("  "),
    )
    staged = star.table(s, d, "lineitem").select((F.col("l_partkey") % 6).alias("form"), raw.alias("raw"))
    x = F.col("raw")
    return staged.groupBy("form").agg(
        F.sum(c.comma_float(x)).alias("comma_sum"), F.sum(c.cell_float(x)).alias("spaced_sum"), F.sum(c.plain_float(x)).alias("plain_sum"),
        F.sum(c.whole_number(x)).alias("whole_sum"), F.sum(c.truncated_int(x)).alias("truncated_sum"), F.max(c.money_text(x)).alias("last_money"),
    )


@query(
    "parse_flags",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS loose,
    CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false END AS portal FROM orders""",
)
def _(s, d):
    raw = _cases(F.col("o_orderkey") % 6, F.lit(" JĀ"), F.lit("nē"), F.lit("1"), F.lit("false"), F.lit("varbūt"), F.lit(""))
    staged = _orders(s, d).select("o_orderkey", raw.alias("raw"))
    return staged.select("o_orderkey", c.loose_flag(F.col("raw")).alias("loose"), c.portal_flag(F.col("raw")).alias("portal"))


@query(
    "pct_tie",
    """SELECT l_partkey, round(count(*) FILTER (l_returnflag = 'A') * 100.0 / count(*), 1) AS accepted_pct,
    round(CAST(sum(l_linenumber) AS DOUBLE) / nullif(count(*) FILTER (l_returnflag = 'R'), 0), 2) AS per_returned FROM lineitem GROUP BY 1""",
)
def _(s, d):
    n = F.count(F.lit(1))
    return star.table(s, d, "lineitem").groupBy("l_partkey").agg(
        c.pct(F.count_if(F.col("l_returnflag") == "A"), n).alias("accepted_pct"),
        c.mean(F.sum("l_linenumber"), F.count_if(F.col("l_returnflag") == "R")).alias("per_returned"),
    )


def _named(s, d):
    n = F.col("c_name")
    raw = _cases(
        F.col("c_custkey") % 5, F.concat(F.lit('SIA  "'), n, F.lit('"')), F.concat(F.lit("Sabiedrība ar ierobežotu atbildību  „"), n, F.lit("”")),
        F.concat(n, F.lit(", VAS")), F.concat(F.lit("Šķūņu ēka "), n), F.lit(""),
    )
    return star.table(s, d, "customer").select("c_custkey", raw.alias("raw"))


@query(
    "party_names",
    """WITH n AS (SELECT c_custkey, c_custkey % 5 AS i, c_name AS n, upper(c_name) AS u FROM customer)
    SELECT c_custkey, CASE i WHEN 0 THEN u WHEN 1 THEN u WHEN 2 THEN u || ',' WHEN 3 THEN 'SKUNU EKA ' || u ELSE 'Nav norādīts' END AS grouped,
    CASE i WHEN 0 THEN u WHEN 1 THEN u WHEN 2 THEN u || ' VAS' WHEN 3 THEN 'ŠĶŪŅU ĒKA ' || u ELSE 'Nav norādīts' END AS simple,
    CASE i WHEN 0 THEN u WHEN 1 THEN u WHEN 2 THEN u || ' VAS' WHEN 3 THEN 'ŠĶŪŅU ĒKA ' || u END AS compared,
    CASE i WHEN 0 THEN 'SIA "' || n || '"' WHEN 1 THEN 'Sabiedrība ar ierobežotu atbildību "' || n || '"' WHEN 2 THEN n || ', VAS'
      WHEN 3 THEN 'Šķūņu ēka ' || n ELSE 'Nav norādīts' END AS shown,
    CASE i WHEN 0 THEN 'SIA "' || n || '"' WHEN 1 THEN 'Sabiedrība ar ierobežotu atbildību "' || n || '"' WHEN 2 THEN n || ', VAS'
      WHEN 3 THEN 'Šķūņu ēka ' || n END AS plain FROM n""",
)
def _(s, d):
    x = F.col("raw")
    return _named(s, d).select(
        "c_custkey", names.party_name(x).alias("grouped"), names.simple_party_name(x).alias("simple"), names.compared_party_name(x).alias("compared"),
        names.display_name(x).alias("shown"), c.plain_text(x).alias("plain"),
    )


@query(
    "fold_documents",
    "SELECT doc_id, md5(lower(strip_accents(text))) AS folded, md5(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))) AS squeezed FROM documents",
)
def _(s, d):
    docs = star.texts(s, d, "documents", "doc_id")
    return docs.select("doc_id", F.md5(names.folded_lower(F.col("text"))).alias("folded"), F.md5(c.squeeze(F.col("text"))).alias("squeezed"))


# Names in other scripts and their folded form (fixed values).
_SCRIPTS = (
    ("Зелёный Край", "зеленыи краи"), ("ﬁrma Άλφα", "firma αλφα"), ("№5 ½", "no5 1⁄2"), ("ǄUNGLA Ǆ", "dzungla dz"), ("ＦＵＬＬ Ōtsu", "full otsu"),
)


@query(
    "fold_scripts",
    f"""SELECT c_custkey, (['{"', '".join(b for _a, b in _SCRIPTS)}'])[CAST(c_custkey % {len(_SCRIPTS)} AS INTEGER) + 1] || ' ' || lower(c_name) AS folded,
    upper((['{"', '".join(b for _a, b in _SCRIPTS)}'])[CAST(c_custkey % {len(_SCRIPTS)} AS INTEGER) + 1]) || ' ' || upper(c_name) AS grouped FROM customer""",
)
def _(s, d):
    """Customers with a name part in Cyrillic, Greek, ligatures or full-width letters, folded and as grouping name."""
    first = F.get(F.array(*(F.lit(a) for a, _b in _SCRIPTS)), (F.col("c_custkey") % len(_SCRIPTS)).cast("int"))
    named = star.table(s, d, "customer").select("c_custkey", F.concat_ws(" ", first, "c_name").alias("name"))
    return named.select("c_custkey", names.folded_lower(F.col("name")).alias("folded"), names.party_name(F.col("name")).alias("grouped"))


@query(
    "match_key",
    """WITH n AS (SELECT c_custkey, c_custkey % 5 AS i, c_name AS n, lower(replace(c_name, '#', ' ')) AS k FROM customer)
    SELECT c_custkey, CASE i WHEN 3 THEN 'jasa eka ' || k WHEN 4 THEN 'eur' ELSE k END AS key,
    CASE i WHEN 0 THEN 'SIA ' || n WHEN 1 THEN n WHEN 2 THEN n || ',' WHEN 3 THEN 'Jāšā Ēka ' || n ELSE 'EUR' END AS trimmed,
    CASE i WHEN 0 THEN lower(n) WHEN 1 THEN lower(n) || ' (reg. nr. 40003356530)' WHEN 2 THEN lower(n) || ', 40003356530 x'
      WHEN 3 THEN 'jasa eka ' || lower(n) ELSE 'eur' END AS core, i <> 4 AS plausible FROM n""",
)
def _(s, d):
    n = F.col("c_name")
    raw = _cases(
        F.col("c_custkey") % 5, F.concat(F.lit("SIA "), n), F.concat(n, F.lit(" (reģ. nr. 40003356530)")), F.concat(n, F.lit(", 40003356530 x")),
        F.concat(F.lit("Jāšā Ēka "), n), F.lit("EUR"),
    )
    x = F.col("raw")
    staged = star.table(s, d, "customer").select("c_custkey", raw.alias("raw"))
    return staged.select(
        "c_custkey", names.match_key(x).alias("key"), names.without_noise(x).alias("trimmed"), names.name_core(x).alias("core"), names.plausible(x).alias("plausible")
    )


@query(
    "reg_numbers",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN '4' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS reg FROM customer""",
)
def _(s, d):
    r = star.reg_of(F.col("c_custkey"))
    raw = _cases(
        F.col("c_custkey") % 4, F.concat(F.lit("LV"), r), F.concat(F.lit(" "), F.substring(r, 1, 4), F.lit(" "), F.substring(r, 5, 7), F.lit(" ")), r,
        F.substring(r, 1, 8),
    )
    return star.table(s, d, "customer").select("c_custkey", c.reg_number(raw).alias("reg"))


@query(
    "addresses",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'rigas iela ' || CAST(c_custkey AS VARCHAR) || ' ' || lower(n_name) END AS address_key,
    CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'Rīgas iela. ' || CAST(c_custkey AS VARCHAR) END AS municipality
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(s, d):
    raw = F.when(
        F.col("c_custkey") % 3 != 2,
        F.concat(F.lit(" Rīgas iela. "), F.col("c_custkey").cast("string"), F.lit(" ,  LV-4701, "), F.col("n_name")),
    ).otherwise(" , ")
    joined = star.table(s, d, "customer").join(star.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", names.address_key(raw).alias("address_key"), names.municipality(raw).alias("municipality"))


@query(
    "urls_keys",
    """WITH p AS (SELECT page_id, url, page_id % 5 AS i, CAST(page_id AS VARCHAR) AS k FROM pages),
    u AS (SELECT page_id, k, i, CASE i WHEN 0 THEN url WHEN 1 THEN 'https://www.eis.gov.lv/a/' || k WHEN 2 THEN 'https://www.eis.gov.lv/b'
      WHEN 3 THEN 'https://www.eis.gov.lv/EKEIS/Supplier/Procurement/' || k WHEN 4 THEN NULL END AS address FROM p)
    SELECT page_id, address, CASE WHEN i IN (1, 3) THEN 'id:' || k WHEN i <> 4 THEN 'url:' || address END AS record_key FROM u""",
)
def _(s, d):
    i, k = F.col("page_id") % 5, F.col("page_id").cast("string")
    url = _cases(i, F.col("url"), F.concat(F.lit("/a/"), k), F.lit('="eis.gov.lv/b"'), F.lit(" "), F.lit(None).cast("string"))
    pid = F.when(i.isin(1, 3), k)
    staged = star.texts(s, d, "pages", "page_id").select("page_id", pid.alias("pid"), c.procurement_url(url, pid).alias("address"))
    return staged.select("page_id", "address", c.record_key(F.col("pid"), F.col("address")).alias("record_key"))


_LABEL_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CPV_LABELS.items())
_SEARCH_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SEARCH_CPV_LABELS.items())


@query(
    "cpv_labels",
    f"""WITH p AS (SELECT p_partkey, CAST(p_partkey % 90 + 10 AS VARCHAR) AS x, CAST(p_partkey % 90 + 10 AS VARCHAR) || '000000-'
      || CAST(p_partkey % 10 AS VARCHAR) AS code FROM part)
    SELECT p_partkey, code, CASE x {_LABEL_CASE} ELSE 'CPV ' || x || 'xxx' END AS category,
    CASE x {_SEARCH_CASE} ELSE 'CPV ' || x || 'xxx' END AS search_label FROM p""",
)
def _(s, d):
    code = star.code_of(F.col("p_partkey"))
    raw = F.concat(F.lit('="'), code, F.lit(' Darbi"'))
    staged = star.table(s, d, "part").select("p_partkey", raw.alias("raw"))
    x = F.col("raw")
    return staged.select(
        "p_partkey", c.cpv_code(x).alias("code"), labels.cpv_category(x).alias("category"), labels.cpv_category(x, fixed.SEARCH_CPV_LABELS).alias("search_label")
    )


_PLACES = {
    "Rīgas iela 5, Cēsu novads": ("Cēsu novads", "Vidzeme"),
    "LV-1050, Brīvības bulvāris 1": ("LV-1050", "Nezināms"),
    "Visā Latvijas Republikas teritorijā": ("Latvija", "Visa Latvija"),
    "Balvu novads (LATVIJA)": ("Balvu novads", "Vidzeme"),
    "-": ("Nav norādīta", "Nezināms"),
    " Jēkabpils., x": ("Jēkabpils", "Zemgale"),
    "Rēzekne": ("Rēzekne", "Latgale"),
    " , ": ("Nav norādīta", "Nezināms"),
    "Ventspils novads": ("Ventspils novads", "Kurzeme"),
    "Ādažu novads": ("Ādažu novads", "Rīga"),
}


@query(
    "regions",
    "SELECT c_custkey, CASE c_custkey % 10 "
    + " ".join(f"WHEN {i} THEN '{b}'" for i, (b, _r) in enumerate(_PLACES.values()))
    + " END AS location_bucket, CASE c_custkey % 10 "
    + " ".join(f"WHEN {i} THEN '{r}'" for i, (_b, r) in enumerate(_PLACES.values()))
    + " END AS planning_region FROM customer",
)
def _(s, d):
    place = F.element_at(F.array(*[F.lit(p) for p in _PLACES]), (F.col("c_custkey") % 10 + 1).cast("int"))
    staged = star.table(s, d, "customer").select("c_custkey", place.alias("place"))
    return staged.select("c_custkey", labels.location_bucket(F.col("place")).alias("location_bucket"), labels.planning_region(F.col("place")).alias("planning_region"))


@query(
    "categories",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'design' WHEN 3 THEN o_orderpriority WHEN 4 THEN o_orderpriority ELSE 'unknown' END AS category FROM orders""",
)
def _(s, d):
    first = _cases(F.col("o_orderkey") % 5, F.lit(" design "), F.lit("unknown"), F.lit('{"a": 1}'), F.lit("  "), F.lit(None).cast("string"))
    second = F.when(F.col("o_orderkey") % 5 >= 3, F.col("o_orderpriority"))
    return _orders(s, d).select("o_orderkey", labels.category(first, second).alias("category"))


@query(
    "size_bands",
    """SELECT CASE WHEN e IS NULL THEN 'Nav paredzamās cenas' WHEN e < 100000 THEN 'Līdz 100k' WHEN e < 500000 THEN '100k-500k'
    WHEN e < 1000000 THEN '500k-1M' WHEN e < 5000000 THEN '1M-5M' ELSE '5M+' END AS band, count(*) AS orders
    FROM (SELECT CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice * (o_orderkey % 20) END AS e FROM orders) GROUP BY 1""",
)
def _(s, d):
    e = F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice") * (F.col("o_orderkey") % 20))
    return _orders(s, d).select(e.alias("e")).groupBy(c.size_band(F.col("e")).alias("band")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "decision_lag",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 40 END AS lag,
    CASE WHEN o_orderkey % 5 IN (1, 3) THEN NULL WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 0 THEN NULL
      ELSE CAST(o_orderdate AS DATE) END AS guarded FROM orders""",
)
def _(s, d):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    deadline = _cases(
        key % 5, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(day, "d.M.yyyy H:mm"), F.date_format(day, "dd.MM.yyyy"), F.lit("drīz"),
        F.lit(""),
    )
    decided = F.date_add(day.cast("date"), (key % 40).cast("int"))
    decision = F.when(key % 2 == 0, F.date_format(decided, "yyyy-MM-dd")).otherwise(F.date_format(decided, "d.M.yyyy"))
    staged = _orders(s, d).select("o_orderkey", deadline.alias("a"), decision.alias("b"))
    lag = c.decision_lag(F.col("a"), F.col("b")).cast("long")
    return staged.select("o_orderkey", lag.alias("lag"), c.guarded_date(F.col("a")).alias("guarded"))


@query(
    "status_flags",
    """SELECT o_orderkey, o_orderkey % 4 IN (0, 2) AS finished FROM orders""",
)
def _(s, d):
    status = _cases(F.col("o_orderkey") % 4, F.lit("Līgums noslēgts"), F.lit("Izsludināts"), F.lit("Contract CLOSED"), F.lit(None).cast("string"))
    return _orders(s, d).select("o_orderkey", labels.finished_status(status).alias("finished"))


@query(
    "enum_synonyms",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'maintenance_service' WHEN 2 THEN 'infrastructure' ELSE 'unknown' END AS domain,
    CASE o_orderkey % 4 WHEN 0 THEN 'design_only' WHEN 1 THEN 'service_only' WHEN 2 THEN 'build_only' ELSE 'unknown' END AS scope,
    CASE o_orderkey % 4 WHEN 0 THEN 'new_build' WHEN 1 THEN 'cleaning' WHEN 2 THEN 'repair' ELSE 'unknown' END AS work,
    CASE o_orderkey % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'small' ELSE 'unknown' END AS scale,
    CASE o_orderkey % 4 WHEN 0 THEN 'building_design' WHEN 1 THEN 'maintenance_cleaning_service' WHEN 2 THEN 'infrastructure_build' ELSE 'unknown' END AS final
    FROM orders""",
)
def _(s, d):
    i = F.col("o_orderkey") % 4
    words = {
        "domain": (labels.domain, (" Buildings", "maintenance service", "infra", "?")),
        "scope": (labels.scope, ("Design Only", "services", "works", "")),
        "work": (labels.work, ("new construction", "snow cleaning", "repair", "x")),
        "scale": (labels.scale, ("MAJOR", "minor", "medium", "unknown")),
        "final": (labels.final_label, ("building design", "Maintenance Cleaning", "infrastructure_new", "renovations")),
    }
    staged = _orders(s, d).select("o_orderkey", *[_cases(i, *[F.lit(w) for w in ws]).alias(n) for n, (_f, ws) in words.items()])
    return staged.select("o_orderkey", *[f(F.col(n)).alias(n) for n, (f, _ws) in words.items()])


@query(
    "json_bids",
    """SELECT CAST(o_orderkey AS VARCHAR) AS procurement_id, i AS pos, CASE WHEN i = 0 THEN 'SIA A' ELSE o_orderpriority END AS name,
    CASE WHEN i = 0 THEN 'A' ELSE o_orderpriority END AS norm_name, CASE WHEN i = 1 THEN o_totalprice END AS price
    FROM orders, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) t(i) WHERE o_orderkey % 4 = 0""",
)
def _(s, d):
    key = F.col("o_orderkey")
    good = F.concat(
        F.lit('[{"name": "SIA A", "suggested_price_eur": "x"}, 7, "y", {"name": "'), F.col("o_orderpriority"), F.lit('", "suggested_price_eur": '),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("}]"),
    )
    text = _cases(key % 4, good, F.lit('{"name": "B"}'), F.lit("not json"), F.lit(None).cast("string"))
    rows = _orders(s, d).select(key.cast("string").alias("procurement_id"), text.alias("procurement_participants_json"))
    return facts.bids_from_json(rows).select("procurement_id", "pos", "name", "norm_name", F.col("price").cast("double").alias("price"))


@query(
    "json_list_lengths",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 END AS list_length FROM orders""",
)
def _(s, d):
    text = _cases(F.col("o_orderkey") % 4, F.lit("[1, {}, null]"), F.lit("[]"), F.lit('{"lots": [1]}'), F.lit("[1"))
    staged = _orders(s, d).select("o_orderkey", text.alias("t"))
    return staged.select("o_orderkey", jsonlists.list_length(F.col("t")).alias("list_length"))


@query(
    "json_in_text",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN o_orderpriority END AS value FROM orders""",
)
def _(s, d):
    body = F.concat(F.lit('{"v": "'), F.col("o_orderpriority"), F.lit('"}'))
    text = _cases(
        F.col("o_orderkey") % 5, body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Here: "), body, F.lit(" done")), F.lit("[1, 2]"),
        F.lit("none"),
    )
    staged = _orders(s, d).select("o_orderkey", text.alias("t"))
    return staged.select("o_orderkey", F.get_json_object(labels.first_json_object(F.col("t")), "$.v").alias("value"))
