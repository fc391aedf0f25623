"""URL screening: a blocked Bloom filter lets possible hits through to an exact join.

An entry names a host (with all its subdomains) and the start of a path. Rules
match any start of the path as text; listed canonical URLs match whole path
segments. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1 << 17
LEAST_WORDS = 64
BITS = (40, 46, 52, 58)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def canonical_entries(listed: DataFrame) -> DataFrame:
    """``host, path`` of listed canonical URLs in ``procurement_url``: no ``www.``, no slash at the end of the path. Null and hostless ones go."""
    host = F.regexp_replace(url_host(F.col("procurement_url")), r"^www\.", "")
    return listed.select(host.alias("host"), F.regexp_replace(url_path(F.col("procurement_url")), "/+$", "").alias("path")).where(F.col("host") != "")


def _hash(kind: Column, host: Column, path: Column) -> Column:
    return F.xxhash64(kind, host, path)


def _mask(hashed: Column) -> Column:
    """Bits of one 64-bit filter block that a hash sets."""
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(hashed, b).bitwiseAND(F.lit(63)).cast("int")) for b in BITS]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def _block(hashed: Column, words: int) -> Column:
    return F.pmod(hashed, F.lit(words))


def _blocks(entries: DataFrame, words: int) -> DataFrame:
    """``id, mask`` of the filter's blocks in which a bit is set; all bits of an entry lie in one block."""
    hashed = _hash(F.col("kind"), F.col("host"), F.col("path"))
    return entries.select(_block(hashed, words).alias("id"), _mask(hashed).alias("mask")).groupBy("id").agg(F.bit_or("mask").alias("mask"))


def blocked_filter(entries: DataFrame, words: int) -> DataFrame:
    """One row with ``filter``: the masks of all ``words`` blocks of 64 bits."""
    dense = entries.sparkSession.range(words).join(_blocks(entries, words), "id", "left")
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
    return dense.agg(F.transform(listed, lambda x: x["mask"]).alias("filter"))


def screen_urls(records: DataFrame, rules: DataFrame, listed: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``procurement_id, host, path, rule, verdict`` of every record, one row per input row.

    ``records`` has ``procurement_id`` and ``procurement_url``; ``rules`` has ``host``,
    ``path`` and ``verdict`` (block or allow); ``listed`` has blocked canonical
    URLs in ``procurement_url``. A rule fits its host and all subdomains if the
    path starts with the rule's; the longest (host and path) wins, at equal length
    the one with the longer host, then block before allow. Without a rule a
    listed URL, or one below it, is blocked and any other allowed.

    Each URL asks once for every shape that entries have (labels of the host,
    characters or segments of the path) and that it is long enough for. Asked keys
    pass the Bloom filter: up to ``most_words`` 64-bit words travel as one value, a
    larger filter stays a table of blocks that the distinct asked hashes are
    joined with. What passes is made distinct and joined exactly with the entries,
    so a hot URL is one row there. Null parts of rules never fit.
    """
    ruled = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.lit("rule").alias("kind"), F.lower("host").alias("host"), "path", "verdict"
    )
    entries = ruled.unionByName(canonical_entries(listed).select(F.lit("list").alias("kind"), "host", "path", F.lit("block").alias("verdict"))).distinct()
    words = LEAST_WORDS
    wanted = entries.count() // 4
    while words < wanted:
        words *= 2

    split = records.select("procurement_id", url_host(F.col("procurement_url")).alias("host"), url_path(F.col("procurement_url")).alias("path"))
    urls = split.where(F.col("host") != "").select(F.col("host").alias("url_host"), F.col("path").alias("url_path"))
    asked = _asked(urls, entries).withColumn("hash", _hash(F.col("kind"), F.col("host"), F.col("path")))
    exact = _possible(asked, entries, words, words <= most_words).drop("hash").distinct().join(entries, ["kind", "host", "path"])
    is_rule = F.col("kind") == "rule"
    rank = F.struct(F.length("host") + F.length("path"), F.length("host"), F.col("verdict") == "block")
    best = exact.groupBy(F.col("url_host").alias("host"), F.col("url_path").alias("path")).agg(
        F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.when(is_rule, rank)).alias("best"),
        F.bool_or(~is_rule).alias("listed"),
    )
    verdict = F.coalesce("best.verdict", F.when(F.col("listed"), "block"), F.lit("allow"))
    return split.join(best, ["host", "path"], "left").select("procurement_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def _parts(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit(""))) + 1


def _asked(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """``url_host, url_path, kind, host, path``: the keys of a URL in the shapes of the entries.

    The different shapes are one scalar value: few, as they count labels and
    characters or segments, not entries.
    """
    size = F.when(F.col("kind") == "rule", F.length("path")).otherwise(_parts(F.col("path"), "/"))
    shape = F.struct("kind", _parts(F.col("host"), ".").alias("labels"), size.alias("size"))
    shapes = entries.agg(F.collect_set(shape).alias("shapes")).scalar()
    trimmed = F.regexp_replace("url_path", "/+$", "")
    rule = F.col("kind") == "rule"
    longest = F.when(rule, F.length("url_path")).otherwise(_parts(trimmed, "/"))
    shaped = urls.select("url_host", "url_path", F.explode(shapes).alias("shape")).select("url_host", "url_path", "shape.*")
    fits = shaped.where((F.col("labels") <= _parts(F.col("url_host"), ".")) & (F.col("size") <= longest))
    start = F.when(rule, F.substring("url_path", F.lit(1), F.col("size"))).otherwise(F.call_function("substring_index", trimmed, F.lit("/"), F.col("size")))
    end = F.call_function("substring_index", F.col("url_host"), F.lit("."), -F.col("labels"))
    return fits.select("url_host", "url_path", "kind", end.alias("host"), start.alias("path"))


def _possible(asked: DataFrame, entries: DataFrame, words: int, small: bool) -> DataFrame:
    """Rows of ``asked`` whose ``hash`` passes the blocked Bloom filter of the entries."""
    if small:
        return asked.where(_passes(F.get(blocked_filter(entries, words).scalar(), _block(F.col("hash"), words).cast("int"))))
    hashes = asked.select("hash").distinct().withColumn("id", _block(F.col("hash"), words))
    return asked.join(hashes.join(_blocks(entries, words), "id").where(_passes(F.col("mask"))).select("hash"), "hash", "left_semi")


def _passes(block: Column) -> Column:
    mask = _mask(F.col("hash"))
    return block.bitwiseAND(mask) == mask
