"""SentencePiece encoding with seeded merge dropout, and decoding, of whole report texts.

Merge-type pieces are built by an agenda: of all neighbours whose join is a
piece, the best piece is merged first, the leftmost of equals, until none is
left. Dropout skips a candidate when a hash of seed, report, place of the word in
the text and place in the word falls below the rate, so every occurrence of a word
is cut by itself, and repeated rows agree. Every segmentation decodes to the text.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANK = "▁"
RATE = 0.1
LONG_WORD = 40
CACHED_WORDS = 1_000_000
# Skips of one word up to which its segmentations are remembered.
CACHED_SKIPS = 2
LOT_CHARS = 2_000_000
MASK = (1 << 64) - 1
# Bits of a place in a hash table of joins.
TABLE_BITS = 20
# Bits of a piece's number in an offer.
PIECE_BITS = 24
# Fixed odd factors of the skip hash.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def skipped(word_key, start, middle, end, rate: float):
    """Whether the candidate that joins ``start..middle`` and ``middle..end`` of a word is skipped; arrays or numbers alike."""
    with np.errstate(over="ignore"):
        x = np.uint64(word_key) if np.isscalar(word_key) else word_key
        for part, factor in zip((start, middle, end), FACTORS):
            x = (x ^ (np.asarray(part, dtype=np.uint64) * np.uint64(factor))) * np.uint64(FACTORS[3])
            x = x ^ (x >> np.uint64(32))
        return (x >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


class Pieces:
    """Merge table of a merge-type SentencePiece model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = processor.get_piece_size()
        text = [processor.id_to_piece(i) for i in range(size)]
        special = [processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i) for i in range(size)]
        self.byte_id = [0] * 256
        self.raw = [b""] * size
        number: dict[str, int] = {}
        for i, piece in enumerate(text):
            if processor.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not special[i]:
                number[piece] = i
                self.raw[i] = piece.replace(BLANK, " ").encode()
        self.score = np.array([processor.get_score(i) for i in range(size)])
        # characters that only occur inside longer pieces are symbols too
        self.symbols = dict(number)
        for piece in number:
            for char in piece:
                self.symbols.setdefault(char, size + len(self.symbols))
        # all bytes of the pieces in a row, and where each piece's begin
        self.raw_size = np.array([len(x) for x in self.raw], dtype=np.int64)
        self.raw_first, self.raw_bytes = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.n_pieces = size
        self.width = max(self.symbols.values(), default=0) + 2
        self.joins: dict[tuple[int, int], int] = {}
        for piece, i in number.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    self.joins[left, right] = i
        self._spread(np.array([a * self.width + b for a, b in self.joins], dtype=np.int64), np.array(list(self.joins.values()), dtype=np.int64))
        self.of_char = np.full(sys.maxunicode + 1, -1, dtype=np.int64)
        for char, symbol in self.symbols.items():
            if len(char) == 1:
                self.of_char[ord(char)] = symbol
        # the best piece has the largest rank
        self.rank = np.searchsorted(np.sort(self.score), self.score)
        inside = {c for piece in number if len(piece) > 1 for c in piece}
        self.apart = re.compile("\n|" + f"{BLANK}*[^{BLANK}\n]+|{BLANK}+" if "\n" not in inside else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        if any(BLANK in piece.lstrip(BLANK) for piece in number):
            raise ValueError("pieces that go on after a blank are not supported")

    def _spread(self, codes: np.ndarray, joined: np.ndarray) -> None:
        """Two hash tables of joins by code; what fits neither stays sorted."""
        self.slots = []
        for factor in FACTORS[:2]:
            place = ((codes.astype(np.uint64) * np.uint64(factor)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            keys, values = np.full(1 << TABLE_BITS, -1, dtype=np.int64), np.full(1 << TABLE_BITS, -1, dtype=np.int64)
            keys[place], values[place] = codes, joined
            self.slots.append((np.uint64(factor), keys, values))
            out = keys[place] != codes
            codes, joined = codes[out], joined[out]
        order = np.argsort(codes)
        self.codes, self.joined = codes[order], joined[order]

    def join(self, codes: np.ndarray) -> np.ndarray:
        """Piece that each code of two neighbours (``left * width + right``) makes, or -1."""
        hashed = codes.astype(np.uint64)
        out = np.full(codes.size, -1, dtype=np.int64)
        for factor, keys, values in self.slots:
            place = ((hashed * factor) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            hit = keys[place] == codes
            out[hit] = values[place[hit]]
        if self.codes.size:
            at = np.minimum(np.searchsorted(self.codes, codes), self.codes.size - 1)
            hit = self.codes[at] == codes
            out[hit] = self.joined[at[hit]]
        return out

    def start_all(self, words: list[str]) -> np.ndarray:
        """``start`` of many words in a row."""
        return self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def start(self, word: str) -> list[int]:
        """Symbols of the characters of ``word``; one without a piece is -1."""
        get = self.symbols.get
        return [get(c, -1) for c in word]

    def finish(self, symbols: list[int], spans: list[str]) -> bytes:
        ids: list[int] = []
        for symbol, span in zip(symbols, spans):
            if 0 <= symbol < self.n_pieces:
                ids.append(symbol)
            else:
                ids.extend(self.byte_id[b] for b in span.encode())
        return np.array(ids, dtype="<u4").tobytes()


def agenda(pieces: Pieces, word: str, word_key: int, rate: float) -> bytes:
    """Ids of one word: candidates come from a heap, best piece and leftmost first."""
    symbols = pieces.start(word)
    n = len(symbols)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left] if left >= 0 else n
        if left < 0 or right >= n:
            return
        piece = pieces.joins.get((symbols[left], symbols[right]))
        if piece is not None and not (rate and skipped(word_key, left, right, ends[right], rate)):
            heapq.heappush(heap, (-int(pieces.rank[piece]), left, right, ends[right], piece))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, left, right, end, piece = heapq.heappop(heap)
        # stale if either side has changed meanwhile
        if not alive[left] or after[left] != right or ends[right] != end or pieces.joins.get((symbols[left], symbols[right])) != piece:
            continue
        symbols[left], ends[left], alive[right] = piece, end, False
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
        offer(before[left])
        offer(left)
    heads = [i for i in range(n) if alive[i]]
    return pieces.finish([symbols[i] for i in heads], [word[i : ends[i]] for i in heads])


def agendas(pieces: Pieces, words: list[str], word_keys: np.ndarray, rate: float) -> list[bytes]:
    """Ids of many short words at once: every round takes the best candidate of each word's agenda."""
    ids, counts, _ = _rounds(pieces, words, lambda word, start, middle, end: skipped(word_keys[word], start, middle, end, rate) if rate else None)
    raw, ends = ids.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def paths(pieces: Pieces, words: list[str], barred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of many short words without the candidates in ``barred`` (sorted ``_code``) in a row, how many each word has, and the merges made.

    The merges come in order: their codes, and how many each word has.
    """

    def skip(word, start, middle, end):
        if not barred.size:
            return None
        code = _code(word, start, middle, end)
        at = np.searchsorted(barred, code)
        at[at == barred.size] = 0
        return barred[at] == code

    ids, n_ids, made = _rounds(pieces, words, skip)
    if not made:
        return ids, n_ids, np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    word = np.concatenate([w for w, _ in made])
    order = np.argsort(word, kind="stable")
    return ids, n_ids, np.concatenate([c for _, c in made])[order], np.bincount(word, minlength=len(words))


def _code(word, start, middle, end):
    """A word's number and a candidate in it as one number."""
    return (word << 18) | (start << 12) | (middle << 6) | end


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of many stretches, one after the other."""
    out = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(out.size)
    return out


def _rounds(pieces: Pieces, words: list[str], skip) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Ids in a row, how many each word has, and words and codes of each round's merges.

    A candidate is weighed once, when its two sides have come about: ``offer`` holds
    the priority of each symbol's join with the next one and the piece it makes, or -1.
    """
    made: list[tuple[np.ndarray, np.ndarray]] = []
    if not words:
        return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), made
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    symbol = pieces.start_all(words)
    word = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes) - sizes
    start = np.arange(symbol.size) - first[word]
    end = start + 1
    offer = np.full(symbol.size, -1, dtype=np.int64)

    def weigh(at: np.ndarray) -> None:
        """Offers of the places ``at``, none of which is the last."""
        offer[at] = -1
        at = at[(word[at] == word[at + 1]) & (symbol[at] >= 0) & (symbol[at + 1] >= 0)]
        piece = pieces.join(symbol[at] * pieces.width + symbol[at + 1])
        at, piece = at[piece >= 0], piece[piece >= 0]
        if at.size and (gone := skip(word[at], start[at], start[at + 1], end[at + 1])) is not None:
            at, piece = at[~gone], piece[~gone]
        offer[at] = ((pieces.rank[piece] * (LONG_WORD + 1) + (LONG_WORD - start[at])) << PIECE_BITS) | piece

    weigh(np.arange(max(symbol.size - 1, 0)))
    out_symbol, out_word, out_start, out_end = [], [], [], []
    while symbol.size:
        lead = np.flatnonzero(np.diff(word, prepend=-1))
        best = np.repeat(np.maximum.reduceat(offer, lead), np.diff(lead, append=word.size))
        keep = best >= 0
        done = ~keep
        for kept, values in ((out_symbol, symbol), (out_word, word), (out_start, start), (out_end, end)):
            kept.append(values[done])
        left = np.flatnonzero((offer == best) & keep)
        made.append((word[left], _code(word[left], start[left], start[left + 1], end[left + 1])))
        symbol[left], end[left] = offer[left] & ((1 << PIECE_BITS) - 1), end[left + 1]
        keep[left + 1] = False
        left = (np.cumsum(keep) - 1)[left]
        symbol, word, start, end, offer = symbol[keep], word[keep], start[keep], end[keep], offer[keep]
        last = left == symbol.size - 1
        offer[left[last]] = -1
        weigh(np.concatenate([left[~last], left[left > 0] - 1]))
    symbol, word, start, end = (np.concatenate(x) for x in (out_symbol, out_word, out_start, out_end))
    order = np.argsort(first[word] + start)
    symbol, word = symbol[order], word[order]
    counts = np.ones(symbol.size, dtype=np.int64)
    odd = np.flatnonzero((symbol < 0) | (symbol >= pieces.n_pieces))
    if not odd.size:
        return symbol.astype("<u4"), np.bincount(word, minlength=len(words)), made
    # spans without a piece become bytes
    start, end = start[order][odd].tolist(), end[order][odd].tolist()
    spelled = [[pieces.byte_id[b] for b in words[i][a:b].encode()] for i, a, b in zip(word[odd].tolist(), start, end)]
    counts[odd] = [len(x) for x in spelled]
    symbol = np.repeat(symbol, counts)
    symbol[_spans((np.cumsum(counts) - counts)[odd], counts[odd])] = np.concatenate(spelled)
    return symbol.astype("<u4"), np.bincount(np.repeat(word, counts), minlength=len(words)), made


class _Known(dict):
    """Node numbers of words; -1 for a word that has none."""

    def __missing__(self, word: str) -> int:
        return -1


class Segmenter:
    """Encodes texts of one model, seed and rate; remembers what does not depend on the keys, for about ``CACHED_WORDS`` segmentations.

    A word's agenda without dropout makes certain merges in a certain order. A
    skipped candidate that is not among them changes nothing; the first one that is
    leads to the agenda without it, which again makes certain merges. So each word
    has a tree: a node is a set of skipped candidates with its merges and ids, and
    an occurrence walks down by its own hashes.
    """

    def __init__(self, model: bytes, seed: int, rate: float):
        self.pieces, self.seed, self.rate = Pieces(model), seed, rate
        self.blank_bytes = np.array([self.pieces.byte_id[b] for b in BLANK.encode()], dtype="<u4").tobytes()
        self._forget()

    def _forget(self) -> None:
        self.known = _Known({"": 0})
        self.word: list[str] = [""]
        self.barred: list[tuple[int, ...]] = [()]
        # of each node, where its merges lie in ``merges`` and its ids in ``ids``; of each merge, the node without it or 0
        room = max(CACHED_WORDS, 1024)
        self.first, self.count, self.first_id, self.n_ids = (np.zeros(room, dtype=np.int64) for _ in range(4))
        self.merges, self.child, self.used = np.zeros(4 * room, dtype=np.int64), np.zeros(4 * room, dtype=np.int64), 0
        self.ids, self.used_ids = np.zeros(4 * room, dtype=np.uint32), len(self.blank_bytes) // 4
        self.ids[: self.used_ids], self.n_ids[0] = np.frombuffer(self.blank_bytes, dtype="<u4"), self.used_ids

    def _key(self, key, n: int) -> np.ndarray:
        """Hash keys of the ``n`` words of a text."""
        import xxhash

        whole = np.uint64(xxhash.xxh64_intdigest(str(key).encode("utf-8", "surrogatepass"), seed=self.seed & MASK))
        x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(FACTORS[0])) ^ whole
        x = (x ^ (x >> np.uint64(29))) * np.uint64(FACTORS[1])
        return x ^ (x >> np.uint64(32))

    def _lay(self, ids: np.ndarray) -> None:
        """Put ids behind those of the nodes."""
        end = self.used_ids + ids.size
        if end > self.ids.size:
            self.ids = np.concatenate([self.ids, np.zeros(max(self.ids.size, end), dtype=np.uint32)])
        self.ids[self.used_ids : end] = ids

    def _grow(self, words: list[str], barred: list[tuple[int, ...]]) -> np.ndarray:
        """Numbers of new nodes."""
        codes = np.array(sorted((i << 18) | c for i, each in enumerate(barred) for c in each), dtype=np.int64)
        ids, n_ids, merges, counts = paths(self.pieces, words, codes)
        at, end, used, used_ids = len(self.word), len(self.word) + len(words), self.used + merges.size, self.used_ids + ids.size
        if end > self.first.size:
            more = np.zeros(max(self.first.size, end), dtype=np.int64)
            self.first, self.count, self.first_id, self.n_ids = (np.concatenate([x, more]) for x in (self.first, self.count, self.first_id, self.n_ids))
        if used > self.merges.size:
            self.merges, self.child = (np.concatenate([x, np.zeros(max(x.size, used), dtype=np.int64)]) for x in (self.merges, self.child))
        self.first[at:end], self.count[at:end] = self.used + np.cumsum(counts) - counts, counts
        self.merges[self.used : used] = merges & ((1 << 18) - 1)
        self.used = used
        self.first_id[at:end], self.n_ids[at:end] = self.used_ids + np.cumsum(n_ids) - n_ids, n_ids
        self._lay(ids)
        self.used_ids = used_ids
        self.word += words
        self.barred += barred
        return np.arange(at, end)

    def _words(self, text: str) -> list[str]:
        """Words of a text; a blank character of the model itself stands alone and becomes bytes."""
        if not text:
            return []
        if BLANK not in text:
            return self.pieces.apart.findall(BLANK + text.replace(" ", BLANK))
        words: list[str] = []
        for i, part in enumerate(text.split(BLANK)):
            if i:
                words.append("")
            words += self.pieces.apart.findall((BLANK if not i else "") + part.replace(" ", BLANK))
        return words

    def encode_lot(self, texts: list[str], keys: list) -> list[bytes]:
        """Ids of each text under its key, as little-endian unsigned 32-bit bytes."""
        cut = [self._words(t) for t in texts]
        words = [w for each in cut for w in each]
        if len(self.word) > CACHED_WORDS:
            self._forget()
        fresh = [w for w in set(words).difference(self.known) if len(w) <= LONG_WORD]
        self.known.update(zip(fresh, self._grow(fresh, [()] * len(fresh)).tolist()))
        out: dict[int, bytes] = {}
        node = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        key = np.concatenate([self._key(k, len(each)) for k, each in zip(keys, cut)] or [np.zeros(0, dtype=np.uint64)])
        for i in np.flatnonzero(node < 0).tolist():
            out[i] = agenda(self.pieces, words[i], int(key[i]), self.rate)
        at = np.flatnonzero(node >= 0)
        if self.rate:
            # merges of the agendas so far that an occurrence has still to pass
            for depth in range(CACHED_SKIPS + 1):
                here = node[at]
                counts = self.count[here]
                owner, place = np.repeat(np.arange(at.size), counts), _spans(self.first[here], counts)
                merge = self.merges[place]
                hit = np.flatnonzero(skipped(np.repeat(key[at], counts), merge >> 12, (merge >> 6) & 63, merge & 63, self.rate))
                # the first skipped merge of each occurrence
                hit = hit[np.diff(owner[hit], prepend=-1) > 0]
                at, place = at[owner[hit]], place[hit]
                if not at.size:
                    break
                if depth == CACHED_SKIPS:
                    for i, ids in zip(at.tolist(), agendas(self.pieces, [words[i] for i in at.tolist()], key[at], self.rate)):
                        out[i] = ids
                    node[at] = -1
                    break
                missing, source = np.unique(place[self.child[place] == 0], return_index=True)
                if missing.size:
                    parents = node[at[self.child[place] == 0][source]].tolist()
                    grown = self._grow([self.word[p] for p in parents], [(*self.barred[p], int(m)) for p, m in zip(parents, self.merges[missing])])
                    self.child[missing] = grown
                node[at] = self.child[place]
        # what was encoded by itself stands behind the nodes' ids until the next lot
        alone = np.fromiter(out, dtype=np.int64, count=len(out))
        first, n = self.first_id[node], self.n_ids[node]
        n[alone] = [len(x) // 4 for x in out.values()]
        first[alone] = self.used_ids + np.cumsum(n[alone]) - n[alone]
        self._lay(np.frombuffer(b"".join(out.values()), dtype="<u4"))
        raw = self.ids[_spans(first, n)].astype("<u4", copy=False).tobytes()
        ends = np.concatenate([[0], 4 * np.cumsum(n)])[np.cumsum([0, *map(len, cut)])].tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def decode(self, ids: bytes) -> str:
        """Text of ids, without the blank that every text is given in front."""
        pieces, each = self.pieces, np.frombuffer(ids, dtype="<u4")
        raw = pieces.raw_bytes[_spans(pieces.raw_first[each], pieces.raw_size[each])].tobytes()
        return raw[1:].decode("utf-8", "replace")


def _segmenter(model: bytes, seed: int, rate: float) -> Segmenter:
    kept = worker_cache("segmenters")
    key = (zlib.crc32(model), seed, rate)
    if key not in kept:
        kept.clear()
        kept[key] = Segmenter(model, seed, rate)
    return kept[key]


def encode_reports(reports: DataFrame, model_path: str, seed: int = 1, rate: float = RATE, keep_ids: bool = True) -> DataFrame:
    """``procurement_id, n_tokens, ids_crc32, lossless`` of every whole report, and its ``ids`` if asked for.

    ``rate`` 0 gives the plain segmentation. The skips depend on the report's id (on
    its text if that is null) and on the place of the word, so repeated rows agree
    and each occurrence of a word is cut by itself. ``lossless`` says that the ids
    decode to the text. A null or empty text has no ids. One pass, no shuffle; a
    worker remembers the merges of words it has met.
    """
    with open(model_path, "rb") as file:
        model = reports.sparkSession.sparkContext.broadcast(file.read())
    kept = reports.select("procurement_id", "report_text")
    fields = [
        T.StructField("procurement_id", kept.schema["procurement_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("lossless", T.BooleanType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    schema = T.StructType(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(model.value, seed, rate)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and held < LOT_CHARS:
                    held += len(texts[stop])
                    stop += 1
                lot = texts[at:stop]
                ids = segmenter.encode_lot(lot, [t if k is None else k for k, t in zip(keys[at:stop], lot)])
                same = [segmenter.decode(x) == t for x, t in zip(ids, lot)]
                columns = [batch.column(0).slice(at, stop - at), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
                if keep_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at = stop

    return kept.mapInArrow(encode, schema)
