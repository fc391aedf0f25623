"""The given star-schema tables seen as procurement tables.

An order is a procurement, its lines are lots, a supplier on an order is a bid,
and the cheapest bid wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import MONEY
from ..functions.names import party_name


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One given table; its schema is read from the footer once per path."""
    path = f"{root}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def texts(spark: SparkSession, root: str, name: str, key: str) -> DataFrame:
    """A text table for heavy per-row work, spread by key when it has fewer files than there are cores."""
    df = table(spark, root, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def _line_value() -> Column:
    gross = F.col("l_extendedprice").cast(MONEY)
    return F.round(gross * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)")), 2).cast(MONEY)


def code_of(part: Column) -> Column:
    """Ten-character procurement code drawn from a part key."""
    return F.concat((part % 90 + 10).cast("string"), F.lit("000000-"), (part % 10).cast("string"))


def lines(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", _line_value().alias("value"), "l_shipdate",
        "l_returnflag", "l_linestatus", "l_tax",
    )


def suppliers(spark: SparkSession, root: str) -> DataFrame:
    """Supplier names as bidders write them: every third with its legal form."""
    written = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('SIA "'), "s_name", F.lit('"'))).otherwise(F.col("s_name"))
    return table(spark, root, "supplier").select(
        "s_suppkey", "s_nationkey", written.alias("name"), party_name(written).alias("norm_name")
    )


def _offers(spark: SparkSession, root: str) -> DataFrame:
    return (
        lines(spark, root)
        .groupBy("l_orderkey", "l_suppkey")
        .agg(
            F.sum("value").cast(MONEY).alias("price"),
            F.min("l_partkey").alias("part"),
            F.max("l_linenumber").alias("lots"),
        )
    )


def bids(spark: SparkSession, root: str) -> DataFrame:
    """One row per procurement and bidder; ``pos`` gives the list order."""
    return (
        _offers(spark, root)
        .join(suppliers(spark, root), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("procurement_id"),
            F.col("l_suppkey").alias("pos"),
            "name",
            "norm_name",
            F.col("l_suppkey").cast("string").alias("reg"),
            "price",
        )
    )


def market_rows(spark: SparkSession, root: str) -> DataFrame:
    """Procurement rows with award, estimate, place, code and lot columns."""
    decided = (
        _offers(spark, root)
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).cast("int").alias("procurement_participants_count"),
            F.min(F.struct("price", F.col("l_suppkey").alias("winner"))).alias("best"),
            F.min("part").alias("part"),
            F.max("lots").alias("lots"),
        )
        .select(
            "l_orderkey", "procurement_participants_count", "part", "lots",
            F.col("best.price").alias("procurement_winner_suggested_price_eur"), F.col("best.winner").alias("winner"),
        )
    )
    winners = suppliers(spark, root).select(
        "s_suppkey", F.col("name").alias("procurement_winner"), F.col("norm_name").alias("winner_normalized")
    )
    buyers = (
        table(spark, root, "customer")
        .join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "c_custkey", F.col("c_name").alias("purchaser_name"), party_name(F.col("c_name")).alias("buyer_normalized"),
            F.col("c_mktsegment").alias("category"), F.col("r_name").alias("planning_region"),
            F.concat("n_name", F.lit(", "), "r_name").alias("delivery_location"),
        )
    )
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    lots = F.col("lots").cast("int")
    return (
        table(spark, root, "orders")
        .join(decided, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(winners, F.col("winner") == F.col("s_suppkey"), "left")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            key.cast("string").alias("procurement_id"),
            F.year(day).alias("year"),
            code_of(F.col("part")).alias("cpv_main"),
            "purchaser_name",
            "buyer_normalized",
            "planning_region",
            "category",
            "delivery_location",
            F.when(key % 10 != 9, F.col("o_totalprice").cast(MONEY)).alias("estimated_value_eur"),
            "procurement_winner",
            "winner_normalized",
            F.col("winner_normalized").alias("winner_display_name"),
            F.col("winner").cast("string").alias("procurement_winner_registration_no"),
            "procurement_winner_suggested_price_eur",
            "procurement_participants_count",
            F.when(urgent, "lowest_price").otherwise("best_value").alias("evaluation_method"),
            F.col("o_orderstatus").alias("procurement_status"),
            F.col("o_orderpriority").alias("procedure_type"),
            F.date_format(day, "dd.MM.yyyy").alias("bid_deadline"),
            F.when(F.col("o_orderstatus") != "P", F.date_format(F.date_add(day, (key % 40).cast("int")), "yyyy-MM-dd")).alias(
                "decision_date"
            ),
            F.when(urgent, F.concat(F.lit("EU-"), "o_orderpriority")).alias("eu_project_reference"),
            F.coalesce(lots >= 5, F.lit(False)).alias("is_multi_lot"),
            F.when(key % 3 != 0, lots).alias("lot_count"),
            F.when(key % 2 == 0, "[1, 2, 3]").otherwise('{"lots": [1, 2]}').alias("lots_json"),
        )
    )


def evaluation_methods(spark: SparkSession, root: str) -> DataFrame:
    """Procurement and evaluation method alone, for jobs that need no other row column."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(spark, root, "orders").select(
        F.col("o_orderkey").cast("string").alias("procurement_id"),
        F.when(urgent, "lowest_price").otherwise("best_value").alias("evaluation_method"),
    )


TOWNS = (
    "Rīga", "Jūrmala, LV-2015", "Cēsu novads, Cēsis", "Liepāja", "Jelgava", "Daugavpils", "Latvija", "Balvu novads",
    "Brīvības iela 1, Salaspils", "-",
)
STATUS = {"O": "Izsludināts", "F": "Līgums noslēgts", "P": "Pārtraukts"}
SUBJECTS = ("Būvdarbi", "Pakalpojums", "Piegāde")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def reg_of(key: Column) -> Column:
    """Eleven-digit registration number of a key."""
    return F.concat(F.lit("4"), F.lpad(key.cast("string"), 10, "0"))


def _deadline(key: Column, day: Column) -> Column:
    text = F.date_format(F.date_add(day, (key % 60).cast("int")), "dd.MM.yyyy")
    return F.when(key % 45 == 3, "").when(key % 45 != 4, text)


def _status(flag: Column) -> Column:
    return F.when(flag == "O", STATUS["O"]).when(flag == "F", STATUS["F"]).otherwise(STATUS["P"])


def announcements(spark: SparkSession, root: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        table(spark, root, "orders")
        .join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            key.cast("string").alias("procurement_id"),
            F.concat_ws(" ", "c_mktsegment", "o_orderpriority", key.cast("string")).alias("title"),
            F.col("c_name").alias("buyer"),
            reg_of(F.col("c_custkey")).alias("buyer_reg_number"),
            F.when(key % 50 == 1, "").when(key % 50 != 0, code_of(key)).alias("cpv_main"),
            _status(F.col("o_orderstatus")).alias("status"),
            F.when(key % 40 != 7, F.date_format(day, "yyyy-MM-dd")).alias("publication_date"),
            _deadline(key, day).alias("submission_deadline"),
            _pick(TOWNS, F.col("c_nationkey")).alias("region"),
            F.when(key % 10 != 9, F.col("o_totalprice")).alias("estimated_value_eur"),
            F.col("o_orderpriority").alias("procedure_type"),
            _pick(SUBJECTS, F.col("c_custkey")).alias("subject_type"),
            F.concat(F.lit("https://portal.example/"), key.cast("string")).alias("eis_url"),
            F.when(key % 3 == 0, "Jā").when(key % 3 == 1, "Nē").alias("has_lots"),
            F.when(urgent, "lowest_price").otherwise("best_value").alias("winner_selection_method"),
            F.lit(None).cast("string").alias("eu_project_reference"),
        )
    )


def results(spark: SparkSession, root: str) -> DataFrame:
    """Accepted lines per (order, supplier) as contract results."""
    won = (
        lines(spark, root)
        .where(F.col("l_returnflag") == "A")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.sum("value").alias("v"), F.min("value").alias("o"), F.max(F.col("l_shipdate").cast("date")).alias("d"))
        .join(suppliers(spark, root), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    signed = F.when(F.col("l_suppkey") % 2 == 0, F.date_format("d", "yyyy-MM-dd")).otherwise(F.date_format("d", "dd.MM.yyyy"))
    return won.select(
        F.col("l_orderkey").cast("string").alias("procurement_id"),
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("procurement_title"),
        F.col("name").alias("winner_name"),
        reg_of(F.col("l_suppkey")).alias("winner_reg_number"),
        F.when(F.col("l_suppkey") % 17 != 0, F.col("v").cast("double")).alias("contract_value_eur"),
        F.col("o").cast("double").alias("contract_value_original_eur"),
        signed.alias("contract_signed_date"),
        F.year("d").alias("source_year"),
    )


def participants(spark: SparkSession, root: str, wide: bool = False) -> DataFrame:
    """Every (order, supplier) as a participant; ``wide`` adds the order's own columns."""
    bid = (
        lines(spark, root)
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.min(F.col("l_shipdate").cast("date")).alias("d"))
        .join(suppliers(spark, root), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    own = [
        F.col("l_orderkey").cast("string").alias("procurement_id"),
        F.col("name").alias("participant_name"),
        reg_of(F.col("l_suppkey")).alias("participant_reg_number"),
        F.date_format("d", "yyyy-MM-dd").alias("participant_submitted_at"),
        F.year("d").alias("source_year"),
    ]
    if not wide:
        return bid.select(*own)
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return bid.join(table(spark, root, "orders"), F.col("l_orderkey") == key).select(
        *own,
        F.concat(F.lit("T"), key.cast("string")).alias("procurement_title"),
        F.concat(F.lit("Buyer "), F.col("o_custkey").cast("string")).alias("buyer"),
        code_of(key).alias("cpv_main"),
        _status(F.col("o_orderstatus")).alias("status"),
        _deadline(key, day).alias("submission_deadline"),
        F.col("o_totalprice").alias("estimated_value_eur"),
    )
