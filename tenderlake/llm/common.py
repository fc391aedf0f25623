"""What several training-data operators share: report rows, worker caches, chunk-wise encoding."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Task helpers travel with the job, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHED_CHUNKS = 700_000
# Characters below this one change case one by one, whatever stands beside them.
PLAIN_CASE = "\u0130"
LONG_CHUNK = 48
LOT_BYTES = 4_000_000
MARKS = ".,!?;:#*$%&|<>"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def as_reports(documents: DataFrame, **more: str) -> DataFrame:
    """``documents`` as reports; ``more`` maps further report columns to document columns."""
    named = {"procurement_id": "doc_id", "report_text": "text", **more}
    return documents.select(*(F.col(old).alias(new) for new, old in named.items()))


def worker_cache(name: str) -> dict:
    """A dict that outlives the task, kept on the interpreter because task code is unpickled anew each time."""
    return sys.__dict__.setdefault(f"_tenderlake_{name}", {})


class Chunks:
    """Ids of texts by their chunks between blanks, as little-endian unsigned 32-bit bytes.

    The tokenizer replaces white space by one blank and drops it, so no token
    reaches over a blank and a text's ids are its chunks' ids in order. Letters
    and the marks after them are separate tokens too, and a plain word goes straight
    to the tokenizer's merges. Two generations of
    ``CACHED_CHUNKS`` chunks are remembered: when the younger is full it becomes the
    older one, from which chunks that are met again come back. Texts go in lots of
    about ``LOT_BYTES``, in which every different chunk is looked up once.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.merges = self.tokenizer.model.tokenize
        # byte-level spelling: printable Latin-1 stands for itself, the other bytes follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelling = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _single(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _fresh(self, chunk: str) -> bytes:
        """Ids of a chunk that the younger generation does not know."""
        ids = self.older.get(chunk)
        if ids is None:
            word = chunk if chunk.isalpha() else chunk.rstrip(MARKS)
            if not word.isalpha() or not (word.isascii() or max(word) < PLAIN_CASE):
                ids = self._single(chunk)
            elif word is chunk and word.islower():
                # lower-case letters: the tokenizer only spells them as bytes before it merges
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelling)
                ids = array("I", [token.id for token in self.merges(spelled)]).tobytes()
            else:
                ids = self._one(word.lower()) + (self._one(chunk[len(word) :]) if len(word) < len(chunk) else b"")
        if len(chunk) <= LONG_CHUNK:
            if len(self.known) > CACHED_CHUNKS:
                self.older, self.known = self.known, {"": b""}
            self.known[chunk] = ids
        return ids

    def _one(self, chunk: str) -> bytes:
        ids = self.known.get(chunk)
        return self._fresh(chunk) if ids is None else ids

    def _lot(self, texts: pa.Array) -> Iterator[bytes]:
        for sign in "\n\t\r":
            texts = pc.replace_substring(texts, sign, " ")
        chunks = pc.split_pattern(texts, " ")
        coded = chunks.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, different))
        if None in ids:
            fresh = self._one
            ids = [fresh(c) if i is None else i for c, i in zip(different, ids)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2
        chunk = coded.indices.to_numpy()
        n = sizes[chunk]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((np.cumsum(sizes) - sizes)[chunk] - ends[:-1], n)
        place += np.arange(place.size)
        raw = np.frombuffer(b"".join(ids), dtype="<u4")[place].tobytes()
        cuts = (4 * ends[np.concatenate([[0], np.cumsum(pc.list_value_length(chunks).to_numpy())])]).tolist()
        return (raw[a:b] for a, b in zip(cuts, cuts[1:]))

    def rest(self) -> None:
        """Let go of the older generation, so that a worker between tasks holds half as much."""
        self.older = {}

    def encode_all(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """Ids of each text; a null text is empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOT_BYTES, side="right")))
            yield from self._lot(texts.slice(at, stop - at))
            at = stop


def chunk_encoder(tokenizer_json: str) -> Chunks:
    """The worker's encoder of this tokenizer, made once per Python worker."""
    kept = worker_cache("chunks")
    if tokenizer_json not in kept:
        kept.clear()
        kept[tokenizer_json] = Chunks(tokenizer_json)
    return kept[tokenizer_json]


def tokenizer_text(path: str) -> str:
    """Tokenizer file as text; a few MB, fit to travel with a job."""
    with open(path, encoding="utf-8") as file:
        return file.read()
