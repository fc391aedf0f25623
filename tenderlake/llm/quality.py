"""Quality rules: word and line measures, and lines that too many documents of a host share.

Everything is DataFrame operations. The host of a report is its ``purchaser_name``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PCT = 30
LEAST_DOCUMENTS = 20
# The limit is a number of documents, whatever the size of the host; a share is a further condition for those who ask for it.
MOST_SHARE = 0.0
LEAST_LEFT = 0.3


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def content_key(text: Column) -> Column:
    """Hash by which equal texts are one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_key(line: Column) -> Column:
    """Hash of a normalised line: lower case, single blanks, digit runs as ``0``."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, BLANK, " ")), "[0-9]+", "0")))


def _line_facts(text: Column) -> Column:
    """``key`` and number of ``words`` of each line that has a word, in order."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(lines, lambda s: F.struct(line_key(s).alias("key"), F.size(words_of(s)).alias("words")))


def measure(reports: DataFrame) -> DataFrame:
    """Measures of every whole report: ``procurement_id, host, content, lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    A null text has no words. Windows of eight words are compared by a 64-bit
    hash; only texts with a window twice sort their windows to count the words
    that lie in repeated ones, so the work stays n log n in the words of a text.
    """
    text = F.coalesce("report_text", F.lit(""))
    base = reports.select("procurement_id", F.col("purchaser_name").alias("host"), text.alias("text"))
    split = base.select(
        "procurement_id", "host", content_key(F.col("text")).alias("content"), _line_facts(F.col("text")).alias("lines"), words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("full"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n, words = F.size("words"), F.col("words")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW)))))
    windowed = split.select("*", hashes.alias("windows"))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeated, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    sorted_ = windowed.select("*", ordered.alias("ordered"))
    row = F.col("ordered")
    again = F.filter(row, lambda x, i: (F.get(row, i - 1)["h"] == x["h"]) | ((i + 1 < F.size(row)) & (F.get(row, i + 1)["h"] == x["h"])))
    placed = sorted_.select("*", F.array_sort(F.transform(again, lambda x: x["at"])).alias("places"))
    start = F.struct(F.lit(-WINDOW).alias("before"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        "places", start, lambda a, at: F.struct(at.alias("before"), (a["total"] + F.least(F.lit(WINDOW), at - a["before"])).alias("total")), lambda a: a["total"]
    )
    return placed.select(
        "procurement_id", "host", "content", "lines", n.cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def frequent_lines(measured: DataFrame, least_documents: int = LEAST_DOCUMENTS, most_share: float = MOST_SHARE) -> DataFrame:
    """``host, key`` of lines in at least ``least_documents`` documents of their host, and over ``most_share`` of them if that is not 0.

    Equal texts are one document; so are several lines of a document that have
    one key. A null host is a host.
    """
    host = F.coalesce("host", F.lit("")).alias("host")
    lines = measured.select(host, "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key")).distinct()
    counted = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents)
    if not most_share:
        return counted.select("host", "key")
    sizes = measured.select(host, "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    return counted.join(sizes, "host").where(F.col("n") > most_share * F.col("documents")).select("host", "key")


def judge(reports: DataFrame, least_documents: int = LEAST_DOCUMENTS, most_share: float = MOST_SHARE) -> DataFrame:
    """Measures and verdict of every report, one row per input row.

    ``reports`` has ``procurement_id``, ``report_text`` and ``purchaser_name``, whose
    documents share boilerplate. Added to the measures: ``removed`` (keys of the
    lines that go because they are above the limits), ``words_left``,
    ``base_failed`` (fewer than 20 words, or over 30 % of them in repeated
    windows) and ``kept``: false if the base failed or if removing lines leaves
    less than ``LEAST_LEFT`` of the words. A common line alone rejects nobody.

    Lines travel as hashes. Counting aggregates before it shuffles, the join that
    finds a document's frequent lines may be split by key, and no list is longer
    than a document's lines.
    """
    measured = written(measure(reports))
    frequent = frequent_lines(measured, least_documents, most_share)
    # equal texts of a host lose the same lines
    there = F.coalesce("host", F.lit("")).alias("host")
    lines = measured.select(there, "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key")).distinct()
    removed = lines.join(frequent, ["host", "key"]).groupBy(F.col("host").alias("at_host"), F.col("content").alias("at_content")).agg(F.collect_list("key").alias("removed"))
    joined = measured.join(removed, (F.coalesce("host", F.lit("")) == F.col("at_host")) & (F.col("content") == F.col("at_content")), "left").drop("at_host", "at_content")
    lost = F.aggregate(
        F.filter("lines", lambda x: F.array_contains(F.col("removed"), x["key"])), F.lit(0).cast("long"), lambda total, x: total + x["words"]
    )
    left = F.when(F.col("removed").isNull(), F.col("n_words")).otherwise(F.col("n_words") - lost)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PCT * F.col("n_words"))
    judged = joined.withColumns({"removed": F.coalesce("removed", F.array().cast("array<long>")), "words_left": left, "base_failed": failed})
    kept = ~F.col("base_failed") & (F.col("words_left") >= LEAST_LEFT * F.col("n_words"))
    return judged.select(
        "procurement_id", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed", "words_left", "base_failed", kept.alias("kept")
    )


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without the lines whose key is in ``removed``; unchanged if that is empty."""
    lines = F.filter(F.split(text, "\n"), lambda s: ~(F.array_contains(removed, line_key(s)) & s.rlike(r"[^\x20\x09-\x0D]")))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(lines, "\n"))
