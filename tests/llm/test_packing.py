import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tenderlake.llm import packing, queries

from .helpers import SF, documents, empty_reports, odd_reports

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows, size):
    tokenizer, out = Tokenizer.from_file(PATH), []
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out += [(key, p, at, min(size, ids.size - at), zlib.crc32(ids[at : at + size].tobytes())) for p, at in enumerate(range(0, ids.size, size))]
    return sorted(out, key=repr)


def check(rows, size, most=None):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r["length"] for r in rows)
    if most is not None:
        assert len(bins) <= max(1, int(most * -(-total // size)) + 1)


def test_documents_against_tokenizer(spark):
    found = queries.op8_best_fit_packing(spark, SF).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute([(r["doc_id"], r["text"]) for r in documents(spark)], 4096)
    check(found, 4096, most=1.01)


def test_odd_rows_and_empty_tables(spark):
    frame = odd_reports(spark)
    pieces = packing.token_pieces(frame, PATH, 1, size=100)
    found = packing.pack(pieces, tokens=100, group_pieces=7).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute([(r["procurement_id"], r["report_text"]) for r in frame.collect()], 100)
    check(found, 100)
    assert packing.pack(packing.token_pieces(empty_reports(spark), PATH, 1)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 60, size=500)
    bins, offsets = packing.best_fit(lengths, (100.0, 4.0, 3000.0), rule)
    for b in range(bins.max() + 1):
        inside = lengths[bins == b]
        assert inside.size
        alone = inside.size == 1
        assert inside.sum() <= 100 and inside.size <= 4 and (alone or (inside**2).sum() <= 3000)
        order = np.argsort(offsets[bins == b])
        assert offsets[bins == b][order].tolist() == (np.cumsum(inside[order]) - inside[order]).tolist()
    assert bins.max() + 1 <= 1.1 * max(lengths.sum() / 100, 500 / 4, (lengths**2).sum() / 3000) + 1
    assert packing.best_fit(np.zeros(0, dtype=np.int64), (10.0, 1.0, 1.0))[0].size == 0
