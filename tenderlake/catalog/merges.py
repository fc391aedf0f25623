"""Merge, comparison and streaming queries; the events table gives keys in arrival order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import alerts, compare, merge
from ..session import shared_folder, written
from ..sources import landing, star
from ..streaming import sync, tiers
from .registry import query
from .relational import ALERTS_SAVED, SAVED, TODAY, saved_of_customers


def result_rows(events):
    """Events as result rows: user is the procurement, event type the winner, id the arrival order."""
    i = F.col("event_id")
    return events.select(
        F.col("user_id").cast("string").alias("procurement_id"),
        F.col("event_type").alias("winner_reg_number"),
        F.when(i % 3 != 0, F.concat(F.lit("T"), i.cast("string"))).alias("procurement_title"),
        F.when(i % 5 != 0, F.concat(F.lit("B"), i.cast("string"))).alias("buyer"),
        F.concat(F.lit("R"), i.cast("string")).alias("buyer_reg_number"),
        F.concat(F.lit("W"), i.cast("string")).alias("winner_name"),
        F.when(i % 4 != 0, F.col("value")).alias("contract_value_eur"),
        F.when(i % 7 != 0, F.col("value")).alias("contract_value_original_eur"),
        F.when(i % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("contract_signed_date"),
        (i % 4 + 2020).cast("int").alias("source_year"),
        i.alias("seq"),
    )


def _events(s, d):
    return star.table(s, d, "events")


def _split(df):
    """Current rows, the first two fifths of all, and the batch that follows them."""
    cut = df.agg(F.max("seq") * 0.4).scalar()
    return df.where(F.col("seq") < cut), df.where(F.col("seq") >= cut)


_CUT = "(SELECT max(event_id) * 0.4 FROM events)"
_EV = """ev AS (SELECT CAST(user_id AS VARCHAR) AS procurement_id, event_type AS winner_reg_number, event_id AS i,
    CASE WHEN event_id % 3 <> 0 THEN 'T' || CAST(event_id AS VARCHAR) END AS title, CASE WHEN event_id % 5 <> 0 THEN 'B' || CAST(event_id AS VARCHAR) END AS buyer,
    CASE WHEN event_id % 4 <> 0 THEN value END AS v, CASE WHEN event_id % 7 <> 0 THEN value END AS o,
    CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') END AS signed, CAST(event_id % 4 + 2020 AS INTEGER) AS y FROM events)"""
_MERGED = f"""WITH {_EV} SELECT procurement_id, winner_reg_number, max(v) AS contract_value_eur,
    arg_min(o, i) FILTER (o IS NOT NULL) AS contract_value_original_eur, arg_max(signed, i) FILTER (signed IS NOT NULL) AS contract_signed_date,
    arg_max(y, i) AS source_year, arg_max(title, i) FILTER (title IS NOT NULL) AS procurement_title,
    (list(buyer ORDER BY i))[1] AS buyer, 'R' || CAST(min(i) AS VARCHAR) AS buyer_reg_number, 'W' || CAST(min(i) AS VARCHAR) AS winner_name
    FROM ev GROUP BY 1, 2"""


@query("merge_results", _MERGED)
def _(s, d):
    current, batch = _split(result_rows(_events(s, d)))
    folded = merge.fold(current, merge.RESULT_KEYS, merge.RESULT_RULES)
    return merge.merge(folded, batch, merge.RESULT_KEYS, merge.RESULT_RULES)


@query(
    "merge_last",
    f"""WITH {_EV} SELECT procurement_id, 'T' || CAST(max(i) AS VARCHAR) AS title, (list(signed ORDER BY i DESC))[1] AS signed,
    (list(v ORDER BY i DESC))[1] AS value FROM ev GROUP BY 1""",
)
def _(s, d):
    rows = result_rows(_events(s, d)).select(
        "procurement_id", F.concat(F.lit("T"), F.col("seq").cast("string")).alias("title"), F.col("contract_signed_date").alias("signed"),
        F.col("contract_value_eur").alias("value"), "seq",
    )
    current, batch = _split(rows)
    return merge.merge_last(merge.fold_last(current, ("procurement_id",)), batch, ("procurement_id",))


@query(
    "merge_write_counts",
    f"""WITH {_EV}, c AS (SELECT DISTINCT procurement_id FROM ev WHERE i < {_CUT}), b AS (SELECT * FROM ev WHERE i >= {_CUT})
    SELECT count(DISTINCT procurement_id) FILTER (procurement_id NOT IN (SELECT procurement_id FROM c)) AS inserted,
    count(*) - count(DISTINCT procurement_id) FILTER (procurement_id NOT IN (SELECT procurement_id FROM c)) AS updated FROM b""",
)
def _(s, d):
    current, batch = _split(result_rows(_events(s, d)))
    return merge.write_counts(merge.fold_last(current, ("procurement_id",)), batch, ("procurement_id",))


_PARTICIPANTS = f"""WITH {_EV} SELECT procurement_id, winner_reg_number AS participant_reg_number, (list(buyer ORDER BY i DESC))[1] AS status,
    arg_max(signed, i) FILTER (signed IS NOT NULL) AS participant_submitted_at, 'W' || CAST(min(i) AS VARCHAR) AS participant_name,
    (list(v ORDER BY i))[1] AS estimated_value_eur, arg_min(y, i) AS source_year FROM ev GROUP BY 1, 2"""
_BUYERS = f"""WITH {_EV} SELECT procurement_id AS reg_number, (list(buyer ORDER BY i DESC))[1] AS organization, (list(signed ORDER BY i))[1] AS registered_date,
    arg_max(i % 2 = 0, i) AS is_blocked FROM ev GROUP BY 1"""


def _participant_rows(results):
    return results.select(
        "procurement_id", F.col("winner_reg_number").alias("participant_reg_number"), F.col("buyer").alias("status"),
        F.col("contract_signed_date").alias("participant_submitted_at"), F.col("winner_name").alias("participant_name"),
        F.col("contract_value_eur").alias("estimated_value_eur"), "source_year", "seq",
    )


def _buyer_rows(results):
    return results.select(
        F.col("procurement_id").alias("reg_number"), F.col("buyer").alias("organization"), F.col("contract_signed_date").alias("registered_date"),
        (F.col("seq") % 2 == 0).alias("is_blocked"), "seq",
    )


@query("merge_participants", _PARTICIPANTS)
def _(s, d):
    current, batch = _split(_participant_rows(result_rows(_events(s, d))))
    folded = merge.fold(current, merge.PARTICIPANT_KEYS, merge.PARTICIPANT_RULES)
    return merge.merge(folded, batch, merge.PARTICIPANT_KEYS, merge.PARTICIPANT_RULES)


@query("merge_buyers", _BUYERS)
def _(s, d):
    current, batch = _split(_buyer_rows(result_rows(_events(s, d))))
    return merge.merge(merge.fold(current, merge.BUYER_KEYS, merge.BUYER_RULES), batch, merge.BUYER_KEYS, merge.BUYER_RULES)


@query(
    "replace_years",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS source_year, l_returnflag AS kind, count(*) AS n FROM lineitem
    WHERE year(l_shipdate) NOT IN (1996, 1998) OR l_returnflag = 'A' GROUP BY ALL""",
)
def _(s, d):
    rows = star.lines(s, d).select(F.year("l_shipdate").alias("source_year"), F.col("l_returnflag").alias("kind"), "l_orderkey")
    batch = rows.where(F.col("source_year").isin(1996, 1998) & (F.col("kind") == "A"))
    return merge.years_replaced(rows, batch).groupBy("source_year", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "merge_records",
    f"""WITH {_EV}, k AS (SELECT *, {_CUT} AS cut, CASE WHEN i % 6 = 0 THEN 'url:http://x/' || procurement_id ELSE 'id:' || procurement_id END AS record_key FROM ev)
    SELECT record_key AS procurement_record_key, 'T' || CAST(max(i) AS VARCHAR) AS procurement_name,
    CASE WHEN max(i) >= any_value(cut) THEN NULL ELSE 'W' || CAST(max(i) AS VARCHAR) END AS procurement_winner,
    (list(CASE WHEN i < cut THEN 'W' || CAST(i AS VARCHAR) END ORDER BY i DESC) FILTER (i < cut))[1] AS kept_winner FROM k GROUP BY 1""",
)
def _(s, d):
    rows = result_rows(_events(s, d))
    i = F.col("seq")
    keyed = rows.select(
        F.when(i % 6 != 0, F.col("procurement_id")).alias("procurement_id"), F.concat(F.lit("http://x/"), "procurement_id").alias("procurement_url"),
        F.concat(F.lit("T"), i.cast("string")).alias("procurement_name"), "winner_name", "seq",
    )
    current, batch = _split(keyed)
    key = F.coalesce(F.concat(F.lit("id:"), "procurement_id"), F.concat(F.lit("url:"), "procurement_url"))
    stored = merge.fold_last(
        current.withColumn("procurement_record_key", key).withColumnRenamed("winner_name", "procurement_winner"), ("procurement_record_key",)
    )
    reset = merge.merge_records(stored, batch.drop("winner_name"))
    kept = merge.merge_records(stored, batch.drop("winner_name"), preserve_outcomes=True)
    return reset.select("procurement_record_key", "procurement_name", "procurement_winner").join(
        kept.select("procurement_record_key", F.col("procurement_winner").alias("kept_winner")), "procurement_record_key"
    )


@query(
    "backfill_fields",
    f"""WITH {_EV} SELECT procurement_id, arg_min(title, i) FILTER (title IS NOT NULL) AS procurement_title,
    arg_min(buyer, i) FILTER (buyer IS NOT NULL) AS buyer FROM ev GROUP BY 1""",
)
def _(s, d):
    rows = result_rows(_events(s, d)).withColumn("buyer", F.coalesce("buyer", F.lit("")))
    return merge.backfill_portal_fields(rows, "procurement_id", ("procurement_title", "buyer"))


@query(
    "apply_outcomes",
    f"""WITH {_EV}, n AS (SELECT procurement_id, (list(buyer ORDER BY i DESC))[1] AS w, arg_max(title, i) FILTER (title IS NOT NULL) AS j FROM ev
      GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS procurement_id, CASE WHEN n.procurement_id IS NULL THEN c_name ELSE w END AS procurement_winner,
    coalesce(j, c_mktsegment) AS procurement_participants_json FROM customer LEFT JOIN n ON n.procurement_id = CAST(c_custkey AS VARCHAR)""",
)
def _(s, d):
    records = star.table(s, d, "customer").select(
        F.col("c_custkey").cast("string").alias("procurement_id"), F.col("c_name").alias("procurement_winner"),
        F.col("c_mktsegment").alias("procurement_participants_json"),
    )
    outcomes = result_rows(_events(s, d)).select(
        "procurement_id", F.col("buyer").alias("procurement_winner"), F.col("procurement_title").alias("procurement_participants_json"), "seq"
    )
    return merge.apply_outcomes(records, outcomes)


@query(
    "disqualified_bidders",
    """SELECT CAST(o_orderkey AS VARCHAR) AS procurement_id, o_orderpriority AS reason FROM orders WHERE o_orderkey % 3 = 0""",
)
def _(s, d):
    odd = F.col("o_orderkey") % 3 == 0
    people = F.array(
        F.struct(F.lit("A").alias("name"), odd.alias("disqualified"), F.col("o_orderpriority").alias("disqualification_reason")),
        F.struct(F.lit("B").alias("name"), F.lit(None).cast("boolean").alias("disqualified"), F.lit("x").alias("disqualification_reason")),
    )
    listed = star.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("procurement_id"), people.alias("p"))
    return listed.select("procurement_id", F.explode(merge.disqualified(F.col("p"))).alias("x")).select("procurement_id", "x.reason")


# --- comparison --------------------------------------------------------------------------


def _stores(s, d):
    """Orders as two stores that differ in names, values, flags and presence."""
    k = F.col("o_orderkey")
    base = star.table(s, d, "orders")
    people = F.concat(F.lit('[{"name": "SIA B", "registration_no": "2"}, {"name": "'), F.col("o_orderpriority"), F.lit('", "registration_no": "1"}]'))
    again = F.concat(F.lit('[{"participant_name": "'), F.col("o_orderpriority"), F.lit('", "reg_no": "1"}, {"name": "B", "participant_reg_number": "2"}]'))
    first = base.where(k % 10 != 0).select(
        k.cast("string").alias("procurement_id"), F.concat(F.lit('SIA "C'), F.col("o_custkey").cast("string"), F.lit('"')).alias("purchaser_name"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("estimated_value_eur"), F.lit("1").alias("has_lots"), people.alias("procurement_participants_json"),
    )
    second = base.where(k % 10 != 1).select(
        k.cast("string").alias("procurement_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("purchaser_name"),
        F.when(k % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("estimated_value_eur"),
        F.when(k % 6 == 0, "Nē").otherwise("true").alias("has_lots"), F.when(k % 9 == 0, "[]").otherwise(again).alias("procurement_participants_json"),
    )
    return first, second


_CMP = """cmp AS (SELECT CAST(o_orderkey AS VARCHAR) AS procurement_id, o_orderkey % 10 <> 0 AS exists_in_first, o_orderkey % 10 <> 1 AS exists_in_second,
    o_orderkey % 10 NOT IN (0, 1) AND o_orderkey % 4 = 0 AS value_off, o_orderkey % 10 NOT IN (0, 1) AND o_orderkey % 6 = 0 AS flag_off,
    o_orderkey % 10 NOT IN (0, 1) AND o_orderkey % 9 = 0 AS list_off,
    CASE WHEN o_orderkey % 10 = 1 THEN 'missing_in_second' WHEN o_orderkey % 10 = 0 THEN 'extra_in_second'
      WHEN o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 OR o_orderkey % 9 = 0 THEN 'field_mismatch' ELSE 'match' END AS overall_status FROM orders)"""


_DIFFERENCES = """SELECT procurement_id, overall_status AS status, '*' AS field FROM cmp WHERE overall_status LIKE '%second'
    UNION ALL SELECT procurement_id, 'field_mismatch', 'estimated_value_eur' FROM cmp WHERE value_off
    UNION ALL SELECT procurement_id, 'field_mismatch', 'has_lots' FROM cmp WHERE flag_off
    UNION ALL SELECT procurement_id, 'field_mismatch', 'procurement_participants_json' FROM cmp WHERE list_off"""


@query("comparison_csv", f"WITH {_CMP} SELECT procurement_id, overall_status AS status, 'record' AS field FROM cmp UNION ALL {_DIFFERENCES}")
def _(s, d):
    """Both comparison files, written and read again."""
    folder = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    wide = written(compare.compare_wide(*_stores(s, d)))
    landing.write_comparison(wide, compare.compare_long(wide), folder)
    files = s.read.option("header", True).option("inferSchema", False)
    records = files.csv(f"{folder}/procurement_comparison").select("procurement_id", F.col("overall_status").alias("status"), F.lit("record").alias("field"))
    return records.unionByName(files.csv(f"{folder}/field_comparison").select("procurement_id", "status", "field"))


@query("record_compare", f"WITH {_CMP} {_DIFFERENCES}")
def _(s, d):
    return compare.compare_long(compare.compare_changed(*_stores(s, d))).select("procurement_id", "status", "field")


_ALIKE = [f for f in compare.FIELD_SETS["all"] if f not in ("estimated_value_eur", "has_lots", "procurement_participants_json")]


@query(
    "compare_summary",
    f"""WITH {_CMP}, m AS (SELECT count(*) FILTER (exists_in_first) AS a, count(*) FILTER (exists_in_second) AS b,
      count(*) FILTER (overall_status = 'match') AS c, count(*) FILTER (overall_status IN ('field_mismatch', 'missing_in_second')) AS e,
      count(*) FILTER (overall_status = 'missing_in_second') AS f, count(*) FILTER (overall_status = 'extra_in_second') AS g,
      count(*) FILTER (value_off) AS h, count(*) FILTER (flag_off) AS i, count(*) FILTER (list_off) AS j FROM cmp)
    SELECT 'first_compared' AS measure, a AS value FROM m UNION ALL SELECT 'second_loaded', b FROM m UNION ALL SELECT 'fully_matched', c FROM m
    UNION ALL SELECT 'with_any_difference', e FROM m UNION ALL SELECT 'missing_in_second', f FROM m UNION ALL SELECT 'extra_in_second', g FROM m
    UNION ALL SELECT 'field:estimated_value_eur', h FROM m UNION ALL SELECT 'field:has_lots', i FROM m
    UNION ALL SELECT 'field:procurement_participants_json', j FROM m
    UNION ALL SELECT unnest({[f"field:{f}" for f in _ALIKE]}), 0""",
)
def _(s, d):
    stores = _stores(s, d)
    return compare.summary_of_changed(compare.compare_changed(*stores), *stores)


@query(
    "compare_business",
    f"WITH {_CMP} SELECT overall_status, count(*) AS records FROM cmp GROUP BY 1",
)
def _(s, d):
    wide = compare.compare_wide(*_stores(s, d), "business")
    return wide.groupBy("overall_status").agg(F.count(F.lit(1)).alias("records"))


@query(
    "compare_sample",
    f"WITH {_CMP} SELECT procurement_id FROM cmp WHERE overall_status IN ('field_mismatch', 'missing_in_second') ORDER BY 1 LIMIT 50",
)
def _(s, d):
    return compare.differing_ids(compare.compare_changed(*_stores(s, d)))


# --- streaming ------------------------------------------------------------------------------


def _landed_events(s, d, parts=4):
    """The events table landed as several files, oldest first, and its schema."""
    folder = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    _events(s, d).repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").write.parquet(f"{folder}/in")
    return folder, _events(s, d).schema


def _streamed(s, d, rows, keys, rules):
    """``rows`` of the landed events, merged by a stream run."""
    folder, schema = _landed_events(s, d)
    source = rows(result_rows(sync.landed_stream(s, f"{folder}/in", schema)))
    sync.sync_keyed(source, keys, rules, f"{folder}/out", f"{folder}/log").awaitTermination()
    out = T.StructType([f for f in source.schema.fields if f.name != "seq"])
    return sync.keyed(s, f"{folder}/out", out, keys, rules)


@query("stream_results", _MERGED)
def _(s, d):
    return _streamed(s, d, lambda results: results, merge.RESULT_KEYS, merge.RESULT_RULES)


@query("stream_participants", _PARTICIPANTS)
def _(s, d):
    return _streamed(s, d, _participant_rows, merge.PARTICIPANT_KEYS, merge.PARTICIPANT_RULES)


@query("stream_buyers", _BUYERS)
def _(s, d):
    return _streamed(s, d, _buyer_rows, merge.BUYER_KEYS, merge.BUYER_RULES)


@query("stream_tiers", _MERGED)
def _(s, d):
    """Results that land ten times, each landing followed by a run that merges it and compacts what is due."""
    folder, events = f"{shared_folder(s)}/{uuid.uuid4().hex}", _events(s, d)
    last, landings = events.agg(F.max("event_id")).first()[0] or 0, 10
    out = T.StructType([f for f in result_rows(events).schema.fields if f.name in (*merge.RESULT_KEYS, *merge.RESULT_RULES)])
    table = tiers.Tiered(f"{folder}/out", out, merge.RESULT_KEYS, merge.RESULT_RULES, fan=3)
    for part in range(landings):
        here = F.floor(F.col("event_id") * landings / (last + 1)) == part
        events.where(here).write.mode("append").parquet(f"{folder}/in")
        source = result_rows(sync.landed_stream(s, f"{folder}/in", events.schema))
        tiers.sync_tiered(source, table, f"{folder}/log").awaitTermination()
    return tiers.current(s, table)


@query(
    "stream_merge",
    f"""WITH {_EV} SELECT procurement_id, 'W' || CAST(max(i) AS VARCHAR) AS winner_name, (list(v ORDER BY i DESC))[1] AS contract_value_eur,
    max(i) AS seq FROM ev GROUP BY 1""",
)
def _(s, d):
    folder, schema = _landed_events(s, d)
    source = result_rows(sync.landed_stream(s, f"{folder}/in", schema, files_per_batch=2)).select("procurement_id", "winner_name", "contract_value_eur", "seq")
    sync.sync_announcements(source, f"{folder}/out", f"{folder}/log").awaitTermination()
    return sync.announcements(s, f"{folder}/out", source.schema)


# Files that the announcements of the alert streams land in, half of them per micro-batch.
LANDED_FILES = 16


@query(
    "stream_alerts",
    """SELECT 'open' AS filter_id, count(*) FILTER (publication_date > '1997-12-01') AS new_count, max(publication_date) AS newest_publication_date
    FROM ann WHERE status IN ('Izsludināts', 'Pieteikumi/piedāvājumi atvērti')
    AND (submission_deadline IS NULL OR submission_deadline = '' OR deadline >= DATE '1998-01-01')
    UNION ALL SELECT 'works', count(*) FILTER (publication_date > '2000-01-01'), max(publication_date) FROM ann WHERE subject_type = 'Būvdarbi'
    UNION ALL SELECT 'build', count(*) FILTER (publication_date > '1999-06-30'), max(publication_date) FROM ann
    WHERE status IN ('Līgums noslēgts', 'Noslēgts', 'Izbeigts', 'Pārtraukts', 'Lēmums pieņemts', 'Uzsākta līguma slēgšana') AND title ILIKE '%building%'""",
)
def _(s, d):
    folder = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    landed = star.announcements(s, d)
    landed.repartition(LANDED_FILES, "procurement_id").write.parquet(f"{folder}/in")
    source = sync.landed_stream(s, f"{folder}/in", landed.schema, files_per_batch=LANDED_FILES // 2)
    saved = written(alerts.saved_searches(s, SAVED))
    sync.sync_alerts(source, lambda b: alerts.alert_counts(b, saved, TODAY), f"{folder}/out", f"{folder}/log").awaitTermination()
    return sync.alerts(s, f"{folder}/out")


@query("stream_alerts_saved", ALERTS_SAVED)
def _(s, d):
    """The saved searches of all customers over announcements that land in micro-batches."""
    folder = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    landed = star.announcements(s, d)
    landed.repartition(LANDED_FILES, "procurement_id").write.parquet(f"{folder}/in")
    source = sync.landed_stream(s, f"{folder}/in", landed.schema, files_per_batch=LANDED_FILES // 2)
    saved = written(saved_of_customers(s, d))
    sync.sync_alerts(source, lambda b: alerts.alert_counts(b, saved, TODAY), f"{folder}/out", f"{folder}/log").awaitTermination()
    return sync.alerts(s, f"{folder}/out")
