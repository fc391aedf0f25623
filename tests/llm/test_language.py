import math
import re
import zlib
from collections import Counter

import pytest

from tenderlake.llm import language, queries

from .helpers import SF, SF_MORE, documents, empty_reports, odd_reports


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r for r in documents(spark, SF_MORE)}
    found = {r["doc_id"]: r for r in queries.op1_language_id(spark, SF_MORE).collect()}
    assert found.keys() == truth.keys()
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    right = sum(found[i]["lang_pred"] == truth[i]["lang"] for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_odd_rows_and_empty_tables(spark):
    reports = odd_reports(spark)
    model = language.train_languages(reports)
    assert model.languages == ("el", "en", "lv")
    rows = language.predict_languages(reports, model).collect()
    assert len(rows) == reports.count()
    found = {r["procurement_id"]: (r["language"], r["score"]) for r in rows}
    for und in (2, 3, 4, 9):
        assert found[und] == ("und", 0.0)
    assert found[1][0] == "en" and found[10][0] == "el"
    nothing = language.train_languages(empty_reports(spark))
    assert nothing.languages == ()
    assert {r["language"] for r in language.predict_languages(reports, nothing).collect()} == {"und"}
    assert language.predict_languages(empty_reports(spark), model).count() == 0


def grams(text):
    """Hashed n-grams of a whole text, one by one."""
    chars = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    for order in language.ORDERS:
        for at in range(len(chars) - order + 1):
            hashed = 0
            for c in chars[at : at + order]:
                hashed = ((hashed ^ ord(c)) * 2654435761) % 2**32
            yield (order - 1) * language.BUCKETS + (hashed >> 17)


def test_against_plain_bayes(spark):
    """Languages and scores of every document equal those of plain counting."""
    rows = documents(spark)
    train = [r for r in rows if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    names = sorted({r["lang"] for r in train})
    counts = {n: Counter() for n in names}
    for r in train:
        counts[r["lang"]].update(grams(r["text"]) if r["text"] else ())
    totals = {n: [sum(v for f, v in counts[n].items() if f // language.BUCKETS == o) + 0.1 * language.BUCKETS for o in range(3)] for n in names}
    sizes = Counter(r["lang"] for r in train)
    found = {r["doc_id"]: r for r in queries.op1_language_id(spark, SF).collect()}
    for r in rows:
        mine = found[r["doc_id"]]
        if not r["text"] or not any(map(str.isalpha, r["text"])):
            assert (mine["lang_pred"], mine["score"]) == ("und", 0.0)
            continue
        seen = Counter(grams(r["text"]))
        logs = {n: math.log(sizes[n] / len(train)) + sum(v * math.log((counts[n][f] + 0.1) / totals[n][f // language.BUCKETS]) for f, v in seen.items()) for n in names}
        best = max(names, key=logs.get)
        assert mine["lang_pred"] == best
        assert abs(mine["score"] - 1 / sum(math.exp(logs[n] - logs[best]) for n in names)) < 1e-3


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_long_texts_lose_nothing_between_pieces(monkeypatch, size):
    monkeypatch.setattr(language, "PIECE_CHARS", size)
    texts = ["ab, cd!!! ... ef", None, "", "....", "x", "ΣΑΣ ΑΣ" * 5, "a" + "-" * 40 + "b", "İİ é 12 zz"]
    found = [Counter() for _ in texts]
    for rows, parts, carried in language._pieces(texts):
        for piece, feature in language._features(parts, carried):
            for p, f in zip(piece, feature):
                found[rows[p]][f] += 1
    assert found == [Counter(grams(t)) if t else Counter() for t in texts]
