"""Best-fit packing of token pieces into sequences under several capacities.

Each piece is a vector: its tokens, one document, and its attention cost (the
square of its length). A sequence has a residual capacity in each. Pieces are
placed longest first into the open sequence that fits under every constraint and
leaves the smallest weighted residual norm (``norm``), or whose used part has the
largest weighted dot product with the piece (``dot``).
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import chunk_encoder, tokenizer_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE_TOKENS = 4096
GROUP_PIECES = 25_000
WEIGHTS = (1.0, 0.05, 0.05)


def token_pieces(reports: DataFrame, tokenizer_path: str, end_id: int, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of every whole report: ``procurement_id, piece, start, length, ids_crc32``.

    A null text is an empty report (its end id alone). Only reports of more than
    ``size`` ids are cut; just the last piece may be shorter. Repeated rows give
    repeated pieces. One pass over the texts, no shuffle.
    """
    kept = reports.select("procurement_id", "report_text")
    schema = T.StructType([
        T.StructField("procurement_id", kept.schema["procurement_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    model, end = reports.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path)), np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_encoder(model.value)
        for batch in batches:
            out: list[tuple] = []
            for row, ids in enumerate(chunks.encode_all(batch.column(1))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            rows, *rest = zip(*out) if out else [()] * 5
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        chunks.rest()

    return kept.mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], rule: str = "dot") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. ``capacity``: tokens, documents and attention cost of a bin.

    Pieces go longest first, equal ones in the given order. Equal scores take the
    oldest bin. A piece that breaks a constraint by itself gets a bin alone.
    """
    n = lengths.size
    cap = np.array(capacity, dtype=np.float64)
    weight = np.array(WEIGHTS) / cap**2
    residual = np.tile(cap, (n, 1))
    filled = np.zeros(n, dtype=np.int64)
    bins, offsets, made = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
    opened = np.zeros(0, dtype=np.intp)
    shortest = float(lengths.min()) if n else 0.0
    for at in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[at], 1.0, float(lengths[at]) ** 2])
        left = residual[opened]
        fits = np.flatnonzero((left >= need).all(axis=1))
        if fits.size:
            if rule == "dot":
                score = ((cap - left[fits]) * need) @ weight
            else:
                score = -(((left[fits] - need) ** 2) @ weight)
            chosen = opened[fits[np.argmax(score)]]
        else:
            chosen, made = made, made + 1
            opened = np.append(opened, chosen)
        bins[at], offsets[at] = chosen, filled[chosen]
        filled[chosen] += int(lengths[at])
        residual[chosen] -= need
        if residual[chosen, 0] < shortest or residual[chosen, 1] < 1:
            opened = opened[opened != chosen]
    return bins, offsets


def pack(
    pieces: DataFrame, tokens: int = SEQUENCE_TOKENS, documents: int | None = None, attention_cost: float | None = None, rule: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the columns of ``token_pieces``.

    Without ``documents`` and ``attention_cost`` these capacities are as large as
    the tokens allow, so they steer the choice but never cost a sequence. Full
    pieces are sequences by themselves. The others are dealt in turn into
    groups of about ``group_pieces``, each packed by one task: a group leaves at
    most its last few sequences unfilled, and no task grows with the input.
    """
    pieces = written(pieces.select("procurement_id", "piece", "start", "length", "ids_crc32"))
    spark, count = pieces.sparkSession, pieces.count()
    groups = max(1, -(-count // group_pieces))
    capacity = (float(tokens), float(documents or tokens), float(attention_cost or float(tokens) ** 2))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        bins, offsets = best_fit(held.column("length").to_numpy(), capacity, rule)
        group = TaskContext.get().partitionId()
        full = held.append_column("sequence_id", pa.array(bins + (group << 32), pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        yield from full.to_batches()

    dealt = pieces.repartition(groups).sortWithinPartitions(F.desc("length"), "procurement_id", "piece")
    return dealt.mapInArrow(place, schema)
