import hashlib
import re
import struct

import pytest
import xxhash

from tenderlake.llm import orderhash, queries

from .helpers import SF, documents, empty_reports, odd_reports

MASK = (1 << 64) - 1


def h(*parts):
    seed = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else struct.pack("<i", p[0]) if isinstance(p, tuple) else struct.pack("<Q", p & MASK)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def signature(text):
    pieces = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    kmers = [h(a, b) for a, b in zip(pieces, pieces[1:])] or [h(p) for p in pieces]
    seen, slots = {}, {}
    for at, kmer in enumerate(kmers):
        seen[kmer] = seen.get(kmer, 0) + 1
        v = h(kmer, (seen[kmer],))
        signed = v - (1 << 64) if v >> 63 else v
        rank = v >> 29
        slot = signed % 64
        slots[slot] = min(slots.get(slot, (rank, at)), (rank, at))
    out = []
    for t in range(32):
        members = sorted((at, rank) for s in (2 * t, 2 * t + 1) if s in slots for rank, at in [slots[s]])
        if members:
            code = h(members[0][1], members[-1][1], sum(s for s in (2 * t, 2 * t + 1) if s in slots))
            out.append(f"{t:02x}:{code & 0xFFFFFFFF:08x}")
    return out


def likeness(a, b):
    most = max(len(a), len(b))
    return len(set(a) & set(b)) / most if most else 1.0


def brute(rows):
    """rows: (id, text) in order."""
    texts = [t or "" for _, t in rows]
    out = []
    for i, (key, _) in enumerate(rows):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        a, b, c = signature(text), signature(edited), signature(following)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), likeness(a, b), likeness(a, c)))
    return out


def same(found, expected):
    assert len(found) == len(expected)
    for a, b in zip(sorted(map(tuple, found), key=repr), sorted(expected, key=repr)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:])


def test_documents_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark)]
    found = queries.op4_order_minhash(spark, SF).collect()
    same(found, brute(rows))
    assert sum(r["near_edited"] > r["near_next"] for r in found) > 0.9 * len(rows)


def test_odd_rows_and_empty_tables(spark):
    frame = odd_reports(spark)
    rows = sorted(((r["procurement_id"], r["report_text"]) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    found = orderhash.fingerprint_edits(frame).collect()
    same(found, brute(rows))
    assert orderhash.fingerprint_edits(empty_reports(spark)).count() == 0


def test_many_ranges(spark, monkeypatch):
    """Ranges of a report or two, with repeated and null ids, give the same rows as one range; so do no drawn starts."""
    rows = [(i // 2 * 7 - 40 if i % 9 else None, " ".join(f"w{(i * j) % 23}" for j in range(i % 11))) for i in range(120)]
    frame = spark.createDataFrame(rows, "procurement_id long, report_text string")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for starts in (1000, 30, 1):
        monkeypatch.setattr(orderhash, "STARTS_PER_TASK", starts)
        same(orderhash.fingerprint_edits(frame).collect(), brute(ordered))


def test_starts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(orderhash, "MOST_STARTS", 50)
    starts, nulls = orderhash._starts(spark.range(20_000).selectExpr("id AS procurement_id"), 1_000)
    assert 20 < len(starts) < 100 and starts[0] == 0 and starts == sorted(set(starts)) and not nulls


def test_order_matters(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[100:] + words[:100]), " ".join(words)]
    frame = spark.createDataFrame(list(enumerate(texts)), "procurement_id long, report_text string")
    found = {r["procurement_id"]: r for r in orderhash.fingerprint_edits(frame).collect()}
    assert found[0]["fingerprint"] == found[2]["fingerprint"]
    # nearly the same k-mers, but those of different halves have changed places
    assert found[0]["near_next"] < 0.8


def test_native_plan(spark):
    plan = queries.op4_order_minhash(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
