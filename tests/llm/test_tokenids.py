import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tenderlake.llm import common, queries, tokenids

from .helpers import SF, documents, empty_reports, odd_reports

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    """rows: (id, text) in order."""
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((key, start, ids.size, zlib.crc32(ids.tobytes())))
        start += ids.size
    return out


def test_documents_against_tokenizer(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark)]
    assert sorted(map(tuple, queries.op7_token_files(spark, SF).collect())) == brute(rows)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    for name, frame in (("odd", odd_reports(spark)), ("empty", empty_reports(spark))):
        tokenids.write_token_file(frame, PATH, 2, str(tmp_path / name))
        rows = sorted(((r["procurement_id"], r["report_text"]) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        found = tokenids.read_token_file(spark, str(tmp_path / name)).collect()
        assert sorted(map(tuple, found), key=lambda r: r[1]) == brute(rows)


def test_chunks_give_the_whole_text_s_ids():
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    signs = ["The", "don't", "we'll", "İstanbul", "ΣΊΣΥΦΟΣ", "e\u0301", " \u0301x", "\u0130", "<|endoftext|>", "a<|startoftext|>b", "1234", "\x1c", "\x85", "\u2003", "ß", "ǅ", "..", ".,!", "x.y.", "'S", "\U0001f3d7\ufe0f", "采购", "ﬁ", "\u1e9e", "½"]
    texts = ["".join(rng.choice(signs) + rng.choice(["", " ", "\n", "\t", "  "]) for _ in range(40)) for _ in range(400)]
    chunks = common.Chunks(common.tokenizer_text(PATH))
    for text, ids in zip(texts, chunks.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_generations(monkeypatch):
    monkeypatch.setattr(common, "CACHED_CHUNKS", 5)
    tokenizer = Tokenizer.from_file(PATH)
    texts = [f"one two Three, {i} four " + "long" * 30 for i in range(30)]
    chunks = common.Chunks(common.tokenizer_text(PATH))
    for text, ids in zip(texts, chunks.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(chunks.known) < 30


def test_grammar_round_trip():
    rng = np.random.default_rng(4)
    for size in (0, 1, 2, 17, 5000):
        for spread in (1, 3, 40000):
            ids = rng.integers(0, spread, size=size).astype(np.uint32)
            symbols, rules, lengths = tokenids.compress(ids, rounds=20)
            assert tokenids._expand(symbols, rules, lengths).tolist() == ids.tolist()
            assert [tokenids._expand(r, rules, lengths).size for r in rules] == lengths.tolist()
            for _ in range(10):
                first = int(rng.integers(0, size + 1))
                count = int(rng.integers(0, size - first + 1))
                assert tokenids.decode_range(symbols, rules, lengths, first, count).tolist() == ids[first : first + count].tolist()
    assert tokenids.compress(np.tile(np.arange(4, dtype=np.uint32), 1000), rounds=20)[0].size < 1500


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    phrases = [rng.integers(0, 40_000, 200) for _ in range(5)]
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 5, 300)]).astype(np.uint32)
    symbols, rules, lengths = tokenids.compress(ids)
    assert (tokenids._expand(symbols, rules, lengths) == ids).all()
    assert lengths.max() > 64 and symbols.size < ids.size / 50
    for salt in range(40, 44):
        everywhere = np.arange(symbols.size - 1)
        assert len(tokenids._pair_round(symbols, everywhere, tokenids.BASE + len(rules), salt)[2]) == 0


def test_linked_rounds_give_the_grammar_of_plain_rounds():
    rng = np.random.default_rng(5)
    phrases = [rng.integers(0, 500, 40) for _ in range(30)]
    ids = np.concatenate([np.concatenate([phrases[i], rng.integers(500, 90_000, 60)]) for i in rng.integers(0, 30, 600)]).astype(np.uint32)
    for places in (ids, ids[: ids.size // 2], np.tile(ids[:3], 900)):
        plain, live, linked, live_linked, made, links = places, np.arange(places.size - 1), places.copy(), np.arange(places.size - 1), 0, tokenids.Links(places.size)
        for turn in range(30):
            plain, live, rules = tokenids._pair_round(plain, live, tokenids.BASE + made, turn)
            linked, live_linked, same = tokenids._pair_round(linked, live_linked, tokenids.BASE + made, turn, links)
            assert rules.tolist() == same.tolist() and linked[links.left].tolist() == plain.tolist()
            assert (np.cumsum(links.left) - 1)[live_linked].tolist() == live.tolist()
            made += len(rules)
        assert made and not links.near.any() and not links.again.any()


def test_each_different_chunk_of_a_lot_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

    tokenizer = Tokenizer.from_file(PATH)
    texts = ["", None, "The notice, the NOTICE\nand\tthe rest. ", "  ", "采购 é́ don't"] * 200
    chunks = common.Chunks(common.tokenizer_text(PATH))
    list(chunks.encode_all(texts))
    chunks.known = Counted(chunks.known)
    for text, ids in zip(texts, chunks.encode_all(pa.array(["cut off", *texts], pa.string())[1:])):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
    assert chunks.known.asked == len({c for t in texts for c in (t or "").replace("\n", " ").replace("\t", " ").split(" ")})
