import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tenderlake.llm import quality, queries

from .helpers import SF_MORE, documents, empty_reports, odd_reports

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def brute(rows, least, share):
    """rows: (id, text, host)."""
    def keys(text):
        return [(re.sub("[0-9]+", "0", " ".join(WORD.findall(x))).lower(), len(WORD.findall(x))) for x in (text or "").split("\n") if WORD.search(x)]

    texts = defaultdict(set)
    for _, text, host in rows:
        texts[host or ""].add(text or "")
    frequent = set()
    for host, each in texts.items():
        seen = Counter(k for t in each for k in {k for k, _ in keys(t)})
        frequent |= {(host, k) for k, n in seen.items() if n >= least and n > share * len(each)}
    out = []
    for key, text, host in rows:
        n, *rest = measures(text)
        left = n - sum(w for k, w in keys(text) if (host or "", k) in frequent)
        failed = n < 20 or 100 * rest[-1] > 30 * n
        out.append((key, n, *rest, left, failed, not failed and left >= 0.3 * n))
    return sorted(out, key=repr)


def shape(df):
    return sorted(map(tuple, df.select("procurement_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_left", "base_failed", "kept").collect()), key=repr)


def test_documents_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents(spark, SF_MORE)]
    frame = spark.read.parquet(f"{SF_MORE}/documents.parquet").selectExpr("doc_id AS procurement_id", "text AS report_text", "source AS purchaser_name")
    assert shape(quality.judge(frame)) == brute(rows, quality.LEAST_DOCUMENTS, quality.MOST_SHARE)
    assert shape(quality.judge(frame, 3, 0.05)) == brute(rows, 3, 0.05)
    found = queries.op9_line_quality(spark, SF_MORE)
    assert found.count() == len(rows) and found.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_depleted_reports_go_and_their_lines(spark):
    menu = "\n".join(f"Menu  entry {i} of the portal with words" for i in range(5))
    rows = [(i, f"{menu}\nonly {i}", "portal") for i in range(30)]
    rows += [(100 + i, menu + "\n" + " ".join(f"own{chr(97 + i % 26)}{chr(97 + j % 26)}x{chr(97 + j // 26)}" for j in range(40)), "portal") for i in range(30)]
    rows += [(200, f"{menu}\nonly 7", "elsewhere")]
    frame = spark.createDataFrame(rows, "procurement_id long, report_text string, purchaser_name string")
    judged = quality.judge(frame)
    assert shape(judged) == brute(rows, quality.LEAST_DOCUMENTS, quality.MOST_SHARE)
    kept = {r["procurement_id"] for r in judged.where("kept").collect()}
    assert kept == {*range(100, 130), 200}
    text = judged.where("procurement_id = 101").join(frame, "procurement_id").select(quality.without_lines(F.col("report_text"), F.col("removed"))).first()[0]
    assert text == " ".join(f"ownb{chr(97 + j % 26)}x{chr(97 + j // 26)}" for j in range(40))


def test_limit_does_not_grow_with_the_host(spark):
    notice = "This notice stands under some pages of the portal"
    rows = [(i, (notice + "\n" if i < 25 else "") + " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + j)}" for j in range(24)), "large") for i in range(300)]
    rows += [(1000 + i, t, "small") for i, t, _ in rows[:19]]
    frame = spark.createDataFrame(rows, "procurement_id long, report_text string, purchaser_name string")
    lost = {r["procurement_id"] for r in quality.judge(frame).where("words_left < n_words").collect()}
    assert lost == set(range(25))


def test_repeated_windows(spark):
    texts = ["a b c d e f g h " * 3, "a " * 9, "1 2 3 4 5 6 7 8 x 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "a b c\n\n \na b c\nA b c"]
    rows = [(i, t, "h") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "procurement_id long, report_text string, purchaser_name string")
    assert shape(quality.judge(frame)) == brute(rows, quality.LEAST_DOCUMENTS, quality.MOST_SHARE)


def test_odd_rows_and_empty_tables(spark):
    frame = odd_reports(spark)
    rows = [(r["procurement_id"], r["report_text"], r["purchaser_name"]) for r in frame.collect()]
    assert shape(quality.judge(frame)) == brute(rows, quality.LEAST_DOCUMENTS, quality.MOST_SHARE)
    assert quality.judge(empty_reports(spark)).count() == 0


def test_native_plan(spark):
    plan = queries.op9_line_quality(spark, SF_MORE)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
