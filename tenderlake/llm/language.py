"""Language of whole report texts by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
MOST_LANGUAGES = 200
PIECE_CHARS = 1_000_000
UNKNOWN = "und"


def _letters() -> np.ndarray:
    kept = worker_cache("letters")
    if "table" not in kept:
        kept["table"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return kept["table"]


def _tail(text: str) -> str:
    """The last letters and blanks, as many as the longest n-gram reaches back, with runs of anything else as one blank."""
    out = ""
    for c in reversed(text):
        c = c if c.isalpha() else " "
        if c != " " or out[:1] != " ":
            out = c + out
        if len(out) == max(ORDERS) - 1:
            break
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Row numbers, lower-cased texts with a blank at both ends, and carried characters, in lots of about ``PIECE_CHARS``.

    A longer text comes in several pieces. Each begins with the tail of the one
    before, so that no n-gram is lost; those inside the carried tail are counted already.
    """
    rows, parts, carried, held = [], [], [], 0
    for row, text in enumerate(texts):
        tail, lowered = "", f" {text.lower()} " if text else ""
        for at in range(0, len(lowered), PIECE_CHARS):
            part = tail + lowered[at : at + PIECE_CHARS]
            rows.append(row)
            parts.append(part)
            carried.append(len(tail))
            held += len(part)
            tail = _tail(part) if at + PIECE_CHARS < len(lowered) else ""
            if held >= PIECE_CHARS:
                yield rows, parts, carried
                rows, parts, carried, held = [], [], [], 0
    if rows:
        yield rows, parts, carried


def _features(parts: list[str], carried: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Piece number and hashed feature of every n-gram, order by order; a run of anything but letters counts as one blank."""
    coded = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for p in parts]
    piece = np.repeat(np.arange(len(parts), dtype=np.int32), [c.size for c in coded])
    code = np.concatenate(coded)
    code = np.where(_letters()[code], code, np.uint32(32))
    keep = np.ones(code.size, dtype=bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (piece[1:] != piece[:-1])
    code, piece = code[keep], piece[keep]
    starts = np.searchsorted(piece, np.arange(len(parts)))
    hashed = np.zeros(code.size, dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if code.size < order:
            return
        hashed = (hashed[: code.size - order + 1] ^ code[order - 1 :]) * np.uint32(2654435761)
        if order in ORDERS:
            fresh = piece[order - 1 :] == piece[: code.size - order + 1]
            for i, n in enumerate(carried):
                if n >= order:
                    fresh[starts[i] : starts[i] + n - order + 1] = False
            feature = (hashed >> np.uint32(17)).astype(np.int32) + ORDERS.index(order) * BUCKETS
            yield piece[: code.size - order + 1][fresh], feature[fresh]


@dataclass(frozen=True)
class LanguageModel:
    """Languages in ascending order, their log priors, and a row of n-gram log probabilities for each."""

    languages: tuple[str, ...]
    prior: np.ndarray
    log_probability: np.ndarray


def train_languages(reports: DataFrame, training_rows: int = 50_000) -> LanguageModel:
    """Fit on reports with ``procurement_id, report_text, language``; rows without a language are left out.

    At most about ``training_rows`` reports of each language are used, chosen by
    a hash of the id; priors count all. N-grams are counted per task and summed
    by Spark; the result is languages x features numbers, whatever the input.
    More than ``MOST_LANGUAGES`` languages are refused. An empty table gives a
    model without languages.
    """
    labelled = reports.where(F.col("language").isNotNull()).select("procurement_id", "report_text", "language")
    sizes = {r["language"]: r["count"] for r in labelled.groupBy("language").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = tuple(sorted(sizes))
    if not names:
        return LanguageModel((), np.zeros(0), np.zeros((0, 0), dtype=np.float32))
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("language") == name, training_rows / sizes[name]).otherwise(share)
    chosen = labelled.where(F.pmod(F.xxhash64("procurement_id"), F.lit(1_000_000)) < share * 1_000_000).select("language", "report_text")
    width, number = len(ORDERS) * BUCKETS, {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names) * width, dtype=np.int64)
        for batch in batches:
            language = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            for rows, parts, carried in _pieces(batch.column(1).to_pylist()):
                row = language[np.array(rows, dtype=np.intp)]
                for piece, feature in _features(parts, carried):
                    total += np.bincount(row[piece] * width + feature, minlength=total.size)
        at = np.flatnonzero(total)
        for start in range(0, at.size, 50_000):
            part = at[start : start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], names=["cell", "n"])

    cells = chosen.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(names) * width)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts = counts.reshape(len(names), len(ORDERS), BUCKETS) + 0.1
    log_probability = np.log(counts / counts.sum(axis=2, keepdims=True)).reshape(len(names), width).astype(np.float32)
    seen = np.array([sizes[x] for x in names], dtype=np.float64)
    return LanguageModel(names, np.log(seen / seen.sum()), log_probability)


def predict_languages(reports: DataFrame, model: LanguageModel) -> DataFrame:
    """``procurement_id, language, score`` of every whole report, one row per input row.

    ``score`` is the posterior probability. A text that is null or has no letter,
    and any text under a model without languages, is ``und`` with score 0. Ties go
    to the first language in ascending order.
    """
    sent = reports.sparkSession.sparkContext.broadcast(model)
    kept = reports.select("procurement_id", "report_text")
    schema = T.StructType([
        T.StructField("procurement_id", kept.schema["procurement_id"].dataType), T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType()),
    ])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            n = batch.num_rows
            total = np.tile(known.prior, (n, 1))
            lettered = np.zeros(n, dtype=bool)
            for rows, parts, carried in _pieces(batch.column(1).to_pylist()):
                row = np.array(rows, dtype=np.intp)
                lettered[[r for r, p in zip(rows, parts) if any(map(str.isalpha, p))]] = True
                for piece, feature in _features(parts, carried):
                    for i, logs in enumerate(known.log_probability):
                        sums = np.bincount(piece, weights=logs[feature], minlength=len(parts))
                        np.add.at(total[:, i], row, sums)
            names, scores = [UNKNOWN] * n, np.zeros(n)
            if known.languages and n:
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                scores = np.where(lettered, share, 0.0)
                names = [known.languages[b] if has else UNKNOWN for b, has in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return kept.mapInArrow(score, schema)
