import random

import numpy as np
import public_tokenizers
import sentencepiece

from tenderlake.llm import dropout, queries

from .helpers import SF, documents, empty_reports, odd_reports

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()


def texts():
    rng = random.Random(6)
    signs = ["The ", "tender", "  ", "\n", "\t", "é", "采购", "\U0001f3d7", "ing", " of", "1234", "...", "Übergröße ", "aaaa", "\x00", "'"]
    return ["".join(rng.choices(signs, k=rng.randrange(1, 40))) for _ in range(300)] + ["", " ", "\n", "word" * 60]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_no_dropout_is_sentencepiece():
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    segmenter = dropout.Segmenter(MODEL, 1, 0.0)
    lot = texts()
    for text, raw in zip(lot, segmenter.encode_lot(lot, [0] * len(lot))):
        assert ids(raw) == reference.encode(text), text


def test_both_agendas_agree_under_dropout():
    pieces = dropout.Pieces(MODEL)
    rng = random.Random(7)
    words = ["▁" + "".join(rng.choices("aeinorstéß采", k=rng.randrange(1, 30))) for _ in range(400)]
    keys = np.array([rng.getrandbits(64) for _ in words], dtype=np.uint64)
    for rate in (0.0, 0.2, 0.7):
        assert dropout.agendas(pieces, words, keys, rate) == [dropout.agenda(pieces, w, int(k), rate) for w, k in zip(words, keys)]


def test_varied_and_lossless():
    lot = [*texts(), "▁ raw ▁▁ blanks ▁", "▁"]
    seen = []
    for seed in (1, 2):
        segmenter = dropout.Segmenter(MODEL, seed, 0.3)
        for variant in (0, 1):
            raw = segmenter.encode_lot(lot, [variant] * len(lot))
            assert [segmenter.decode(x) for x in raw] == lot
            seen.append(b"".join(raw))
    assert len(set(seen)) == 4
    again = dropout.Segmenter(MODEL, 1, 0.3).encode_lot(lot, [0] * len(lot))
    assert b"".join(again) == seen[0]


def test_documents_are_lossless(spark):
    found = queries.op10_merge_dropout(spark, SF).collect()
    assert len(found) == len(documents(spark)) and all(r["lossless"] for r in found)
    plain = {r["procurement_id"]: r["n_tokens"] for r in dropout.encode_reports(queries.as_reports(queries.table(spark, SF, "documents")), PATH, rate=0.0).collect()}
    assert sum(r["n_tokens"] for r in found) > 1.02 * sum(plain.values())


def test_odd_rows_and_empty_tables(spark):
    frame = odd_reports(spark)
    found = dropout.encode_reports(frame, PATH).collect()
    assert len(found) == frame.count() and all(r["lossless"] for r in found)
    assert {r["n_tokens"] for r in found if r["procurement_id"] in (2, 3)} == {0}
    assert len({bytes(r["ids"]) for r in found if r["procurement_id"] == 7}) == 1
    assert dropout.encode_reports(empty_reports(spark), PATH).count() == 0


def test_small_cache(monkeypatch):
    monkeypatch.setattr(dropout, "CACHED_WORDS", 10)
    lot = texts()
    assert dropout.Segmenter(MODEL, 1, 0.2).encode_lot(lot, [i % 3 for i in range(len(lot))]) == [
        dropout.Segmenter(MODEL, 1, 0.2).encode_lot([t], [i % 3])[0] for i, t in enumerate(lot)
    ]


def test_every_occurrence_is_cut_by_itself():
    word = " " + "unterhaltsreinigung"
    segmenter = dropout.Segmenter(MODEL, 1, 0.3)
    cuts = {segmenter.encode_lot([word[1:]], [i])[0] for i in range(300)}
    assert len(cuts) > 20
    inside = segmenter.encode_lot([(word * 300)[1:]], [7])[0]
    size = len(segmenter.encode_lot([word[1:]], [7])[0])
    assert inside != inside[:size] * 300 and segmenter.decode(inside) == (word * 300)[1:]


def test_remembered_merges_give_the_agenda_of_each_occurrence():
    rng = random.Random(8)
    lot = texts() + ["".join(rng.choices("aeinorst ", k=200)) for _ in range(50)]
    for rate in (0.1, 0.5):
        segmenter = dropout.Segmenter(MODEL, 1, rate)
        for _ in range(2):
            for i, (text, raw) in enumerate(zip(lot, segmenter.encode_lot(lot, list(range(len(lot)))))):
                words = segmenter._words(text)
                assert raw == b"".join(dropout.agenda(segmenter.pieces, w, int(k), rate) if w else segmenter.blank_bytes for w, k in zip(words, segmenter._key(i, len(words))))


def test_each_candidate_is_weighed_once():
    pieces, weighed = dropout.Pieces(MODEL), []
    join = pieces.join
    pieces.join = lambda codes: (weighed.append(codes.size), join(codes))[1]
    words = ["▁unterhaltsreinigung", "▁notice", "\n", "▁", "▁采购公告é\U0001f3d7", "▁" + "tender" * 6]
    *_, merges = dropout.paths(pieces, words, np.zeros(0, dtype=np.int64))
    assert sum(weighed) <= sum(len(w) - 1 for w in words) + 2 * merges.sum()
    for rate in (0.0, 0.3):
        keys = np.arange(1, len(words) + 1, dtype=np.uint64)
        assert dropout.agendas(pieces, words, keys, rate) == [dropout.agenda(pieces, w, int(k), rate) for w, k in zip(words, keys)]
