"""Order MinHash fingerprints of report texts, sensitive to edit distance.

Words are cut into pieces of at most ``PIECE`` characters; two pieces in a row are
a k-mer, and each k-mer carries its occurrence number, so a repeated passage is
not the same as a single one. The numbered k-mers are dealt by one hash to
``2 * TUPLES`` slots. Each slot selects its minimal k-mer, two slots make a tuple,
and the tuple is hashed in the order its members have in the text. Everything is
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TUPLES = 32
PIECE = 16
RANK_BITS = 35
PLACE_BITS = 28
# Characters of a task's reports: their k-mers are sorted in memory.
TASK_CHARS = 4_000_000
STARTS_PER_TASK = 4
MOST_STARTS = 1 << 17
DRAWS = 1 << 40


def kmers(text: Column) -> Column:
    """Hashes of the k-mers of a text, in order; a single piece is one k-mer, no piece none."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))

    def hashes(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
        return F.when(F.size(w) >= 2, pairs).otherwise(F.transform(w, lambda x: F.xxhash64(x)))

    # bound as a lambda variable, so the pieces are cut once
    return F.flatten(F.transform(F.array(pieces), hashes))


def order_signatures(texts: DataFrame, key: list[str]) -> DataFrame:
    """``signature`` (sorted array of ``slot:code`` texts) per ``key`` of ``texts`` (``key``, ``at``, ``hashes``).

    One row per k-mer: ``at`` is its place, ``hash`` its hash. If the rows are
    already clustered by the first key column nothing is shuffled.
    """
    same = F.xxhash64("hash", *key[1:])
    numbered = texts.withColumn("same", same).select(
        *key, "at", F.xxhash64("hash", F.row_number().over(Window.partitionBy("same", *key, "hash").orderBy("at"))).alias("v")
    )
    slot = F.pmod("v", F.lit(2 * TUPLES)).cast("int")
    rank = F.shiftrightunsigned(F.col("v"), 64 - RANK_BITS)
    packed = F.shiftleft(rank, PLACE_BITS).bitwiseOR(F.col("at").cast("long").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    least = numbered.groupBy(*key, slot.alias("slot")).agg(F.min(packed).alias("least"))
    # text order decides inside a tuple: the place leads, the k-mer's rank follows
    placed = F.shiftleft(F.col("least").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)), RANK_BITS).bitwiseOR(F.shiftrightunsigned(F.col("least"), PLACE_BITS))
    tuples = least.groupBy(*key, F.shiftright(F.col("slot"), 1).alias("tuple")).agg(F.min(placed).alias("first"), F.max(placed).alias("second"), F.sum("slot").alias("slots"))
    of = F.lit((1 << RANK_BITS) - 1)
    code = F.xxhash64(F.col("first").bitwiseAND(of), F.col("second").bitwiseAND(of), "slots")
    entry = F.concat(F.lower(F.lpad(F.hex("tuple"), 2, "0")), F.lit(":"), F.lower(F.substring(F.lpad(F.hex(code), 16, "0"), 9, 8)))
    return tuples.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples of two signatures, 0 to 1; two empty ones are alike."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def _starts(reports: DataFrame, tasks: int) -> tuple[list, bool]:
    """First ids of ranges of ids in ascending order, and whether there are null ids.

    Ranges start at the least id and at ids drawn by a hash, some
    ``STARTS_PER_TASK`` a task and about ``MOST_STARTS`` at most: from there on
    ranges grow with the data and tasks spill. So what the driver and the plan
    hold is bounded, and nothing else is sampled.
    """
    key = F.col("procurement_id")
    whole = reports.agg(F.count(key).alias("n"), F.min(key).alias("first"), F.bool_or(key.isNull()).alias("nulls")).first()
    share = min(1.0, min(STARTS_PER_TASK * tasks, MOST_STARTS) / max(whole["n"], 1))
    drawn = reports.where(key.isNotNull() & (F.pmod(F.xxhash64(key, F.lit("range")), F.lit(DRAWS)) < int(share * DRAWS))).select(key).distinct()
    starts = {r[0] for r in drawn.collect()}
    return sorted(starts | {whole["first"]} if whole["n"] else starts), bool(whole["nulls"])


def _group_of(key: Column, starts: list) -> Column:
    """How many of the sorted ``starts`` but the first are at most ``key``, by binary search; 0 for null."""
    if len(starts) < 2:
        return F.lit(0)
    bounds, step = F.array(*(F.lit(s) for s in starts[1:])), 1
    while step * 2 < len(starts):
        step *= 2
    steps = []
    while step:
        steps.append(F.lit(step))
        step //= 2
    n = len(starts) - 1
    return F.aggregate(
        F.array(*steps), F.lit(0), lambda low, s: F.when((low + s <= n) & (F.get(bounds, low + s - 1) <= key), low + s).otherwise(low)
    )


def fingerprint_edits(reports: DataFrame) -> DataFrame:
    """Fingerprints of every whole report and of its edited text, and how alike they are.

    The edited text has the last quarter of the code points (rounded down)
    replaced by the first as many (or all) of the next report's, in ascending
    ``procurement_id``; the last report's next is the first. A null text is empty,
    a null id comes first, equal ids are ordered by text, repeated rows follow
    each other. Columns: ``procurement_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``; one row per input row.

    Reports meet their next one in ranges of ids. The first report of a range is
    also sent to the range before, so one shuffle of the texts serves the order,
    the k-mers and their grouping; only signatures are shuffled again.
    """
    spark = reports.sparkSession
    kept = reports.select("procurement_id", F.coalesce("report_text", F.lit("")).alias("text"))
    chars = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))
    starts, nulls = _starts(kept, tasks)
    own = F.coalesce(_group_of(F.col("procurement_id"), starts), F.lit(0)).cast("int")
    last = F.lit(max(0, len(starts) - 1))
    key = F.col("procurement_id")
    opens = key.isNull() if nulls else key == F.lit(starts[0]) if starts else F.lit(False)
    begins = key.isin(starts[1:]) if len(starts) > 1 else F.lit(False)
    targets = [(own, 0, F.lit(True)), (own - 1, 1, begins), (last, 1, opens)]
    sent = F.explode(F.array(*(F.struct(g.alias("group"), F.lit(a).alias("ahead"), F.coalesce(on, F.lit(False)).alias("goes")) for g, a, on in targets)))
    dealt = kept.select("procurement_id", "text", sent.alias("to")).where("to.goes").select("to.group", "to.ahead", "procurement_id", "text").repartition(tasks, "group")
    order = Window.partitionBy("group").orderBy("ahead", F.col("procurement_id").asc_nulls_first(), "text")
    placed = dealt.select("*", F.row_number().over(order).cast("int").alias("row"), F.lead("text").over(order).alias("next_text"), F.lag("ahead", 1, 0).over(order).alias("ahead_before"))
    placed = placed.where("ahead = 0 OR ahead_before = 0")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.when(F.col("ahead") == 0, F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)))
    ready = placed.select("group", "row", "ahead", "procurement_id", "text", edited.alias("edited"))

    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.coalesce("edited", F.lit("")).alias("t")))
    rows = ready.select("group", "row", F.explode(both).alias("x")).select("group", "row", "x.kind", F.posexplode(kmers(F.col("x.t"))).alias("at", "hash"))
    signed = order_signatures(rows, ["group", "row", "kind"])
    mine, changed = (F.max(F.when(F.col("kind") == k, F.col("signature"))) for k in (0, 1))
    pairs = signed.groupBy("group", "row").agg(mine.alias("mine"), changed.alias("changed"))
    facts = ready.select("group", "row", "ahead", "procurement_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    none = F.array().cast("array<string>")
    full = facts.join(pairs, ["group", "row"], "left").select(
        "group", "row", "ahead", "procurement_id", "n_chars", "edited_sha256", F.coalesce("mine", none).alias("mine"), F.coalesce("changed", none).alias("changed")
    )
    beside = full.select("*", F.lead("mine").over(Window.partitionBy("group").orderBy("row")).alias("next_mine")).where("ahead = 0")
    return beside.select(
        "procurement_id", "n_chars", "edited_sha256", F.array_join("mine", "").alias("fingerprint"), F.array_join("changed", "").alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("changed")).alias("near_edited"), likeness(F.col("mine"), F.col("next_mine")).alias("near_next"),
    )
