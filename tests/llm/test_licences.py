import random
import re

from tenderlake.llm import licences, queries

from .helpers import SF_MORE, documents, empty_reports, odd_reports


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licences.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), places


def check(rows, texts):
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts):
        n, places = brute(text)
        starts = [s for s, _ in places]
        labels = {x for _, x in places}
        assert (row["n_words"], row["n_base"]) == (n, len(places))
        assert (row["first_word"], row["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert row["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(filter(None, row["labels"].split(",")))
        assert 0 <= row["score"] <= 1


def test_documents_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF_MORE)}
    rows = queries.op3_licence_scan(spark, SF_MORE).collect()
    check(rows, [texts[r["doc_id"]] for r in rows])


def test_random_phrases_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = sorted({w for p, _ in licences.PHRASES for w in p.split()}) + ["CC", "Mit", "Key", "and"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(60))).replace("cc by nc", "CC-BY/NC") for _ in range(300)]
    texts += ["cc by nc cc by nc by nc", "apache license version 2 apache license version 2", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "procurement_id long, report_text string")
    check(licences.scan_licences(frame).orderBy("procurement_id").collect(), texts)


def test_matching_statistics_against_brute_force():
    rng = random.Random(9)
    templates = [" ".join(rng.choices("abc", k=rng.randrange(3, 12))) for _ in range(5)]
    automaton = licences.build_automaton([(t, "x") for t in templates])
    split = [t.split() for t in templates]
    for _ in range(200):
        words = rng.choices("abcd", k=30)
        _, long = licences.matches([w.encode() for w in words], automaton, 0, least=1)
        runs = {}
        for end in range(1, 31):
            best = 0
            for t in split:
                for i in range(len(t)):
                    k = 0
                    while k < end and k <= i and t[i - k] == words[end - 1 - k]:
                        k += 1
                    best = max(best, k)
            runs[end] = best
        expected = [(e - runs[e], e) for e in range(1, 31) if runs[e] and (e == 30 or runs[e + 1] <= runs[e])]
        assert [(a, b) for a, b, _ in long] == expected


def test_notices_become_spans(spark):
    notice, label = licences.NOTICES[4]
    words = notice.split()
    broken = " ".join(words[:30] + ["inserted", "words"] + words[32:])
    texts = ["before it " + notice + " after it", broken, " ".join(words[:8]), notice + " " + notice]
    frame = spark.createDataFrame(list(enumerate(texts)), "procurement_id long, report_text string")
    rows = licences.scan_licences(frame).orderBy("procurement_id").collect()
    assert [r["labels"] for r in rows] == [label, label, "", label]
    size = len(licences.words_of(notice))
    assert [(s["start"], s["stop"]) for s in rows[0]["spans"]] == [(2, 2 + size)] and rows[0]["score"] == 1.0
    assert 0.9 < rows[1]["score"] < 1
    assert len(rows[3]["spans"]) == 2


def test_odd_rows_and_empty_tables(spark):
    frame = odd_reports(spark)
    rows = licences.scan_licences(frame).collect()
    check(rows, [r["report_text"] for r in frame.collect()])
    assert licences.scan_licences(empty_reports(spark)).count() == 0
