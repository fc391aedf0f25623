import re
import time

from pyspark.sql import functions as F

from tenderlake.llm import queries, urls

from .helpers import SF_MORE


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute(url, rules, listed):
    host, path = split(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[3:] if fits else (None, None)
    bad = False
    for x in listed:
        h, p = split(x)
        h, p = re.sub(r"^www\.", "", h), p.rstrip("/")
        own = path.rstrip("/")
        bad |= h != "" and (host == h or host.endswith("." + h)) and (own == p or own.startswith(p + "/"))
    return host, path, rule, verdict or ("block" if bad else "allow")


def run(spark, pages, rules, listed, **limits):
    records = spark.createDataFrame(pages, "procurement_id long, procurement_url string").selectExpr("*", "'clash' AS host", "'clash' AS verdict")
    found = urls.screen_urls(records, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(x,) for x in listed], "procurement_url string"), **limits)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted(((i, *brute(u, rules, listed)) for i, u in pages), key=repr)


def test_pages_against_brute_force(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF_MORE}/pages.parquet").collect()}
    found = queries.op6_url_filter(spark, SF_MORE).collect()
    listed = [*queries.LISTED, *(u for i, u in pages.items() if i % 100 == 0)]
    assert len(found) == len(pages) and len(listed) > len(queries.LISTED)
    for r in found:
        assert tuple(r)[1:] == brute(pages[r["page_id"]], queries.RULES, listed)
    assert {r["verdict"] for r in found} == {"allow", "block"}


ODD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://NET/x"), (6, "http://a.b.net"), (7, "https://a.net/?q"), (8, "x://y://net/z"),
    (9, "http://example.net/en/1#a?b"), (9, "http://example.net/en/1#a?b"), (None, "http://evil.org/bad/page/?x"), (10, "http://sub.evil.org/bad/pages"),
    (11, "http://evil.org/bad/page/below/" + "x" * 50_000), (12, "http://a..net//"), (13, "http://fakenet/"), (14, "http://example.net/EN/"), (15, "http://Élan.net/"),
]


def test_odd_urls(spark):
    rules = [*queries.RULES, ("net", "/", "allow"), ("deep.example.net", "/e", "block")]
    run(spark, ODD, rules, ["https://www.evil.org/bad/page/", "http://evil.org/other", "not a url", "http://a.b.net"])


def test_empty_sides(spark):
    run(spark, [], list(queries.RULES), ["http://a.net"])
    run(spark, ODD, list(queries.RULES), [])
    run(spark, ODD, [], ["http://evil.org"])
    run(spark, ODD, [], [])


def test_filter_holds_every_entry(spark):
    entries = spark.range(3000).selectExpr("'list' AS kind", "concat('h', id) AS host", "'' AS path")
    bloom = urls.blocked_filter(entries, 1024).scalar()
    passing = urls._passes(F.get(bloom, urls._block(F.col("hash"), 1024).cast("int")))
    hashed = urls._hash(F.col("kind"), F.col("host"), F.col("path"))
    passed = entries.withColumn("hash", hashed).where(passing).count()
    others = spark.range(3000).selectExpr("'list' AS kind", "concat('g', id) AS host", "'' AS path").withColumn("hash", hashed)
    assert passed == 3000 and others.where(passing).count() < 600
    # the filter that stays a table passes the same rows
    assert urls._possible(others, entries, 1024, False).count() == others.where(passing).count()


def test_filter_as_a_table(spark):
    rules = [*queries.RULES, ("net", "/", "allow"), ("deep.example.net", "/e", "block")]
    run(spark, ODD, rules, ["https://www.evil.org/bad/page/", "http://evil.org/other", "http://a.b.net"], most_words=1)


def test_urls_of_many_segments(spark):
    """Seconds, not minutes: a URL asks for the shapes of the entries, not for all of its path starts."""
    path = "/a" * 50_000
    pages = [(1, "http://deep.evil.org" + path), (2, "http://x" + ".y" * 5_000 + ".evil.org/a/a/b"), (3, "http://evil.org/" + "/" * 50_000)]
    started = time.monotonic()
    run(spark, pages, [*queries.RULES, ("org", "/a" * 40_000, "allow")], ["http://evil.org/a/a", "http://deep.evil.org" + "/a" * 30_000])
    assert time.monotonic() - started < 30


def test_native_plan(spark):
    plan = queries.op6_url_filter(spark, SF_MORE)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
