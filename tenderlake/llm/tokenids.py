"""Token-id files: Re-Pair grammar blocks with expansion lengths for random access.

File format: a Parquet table with one row per block, in ascending (``shard``,
``block``) order of the reports. ``symbols`` holds the block's remaining symbols;
a symbol of at least ``BASE`` stands for rule ``symbol - BASE``, whose two symbols
are in ``rules`` and whose number of ids is in ``lengths`` (all little-endian
unsigned 32-bit). ``ids`` of the reports and ``ends`` (running id counts inside
the block) say where each report lies.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from .common import chunk_encoder, tokenizer_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 1 << 24
BLOCK_IDS = 1_000_000
LEAST_USES = 8
SLOT_BITS = 18


class Links:
    """Neighbours of the places that are left of a sequence, once few of them change; place ``size`` stands for none."""

    def __init__(self, size: int):
        self.before, self.after = np.arange(-1, size), np.arange(1, size + 2)
        self.before[0] = self.after[size] = size
        self.left = np.ones(size, dtype=bool)
        # nought between rounds
        self.near, self.again = np.zeros(size + 1, dtype=np.int32), np.zeros(size + 1, dtype=bool)


def _pair_round(seq: np.ndarray, live: np.ndarray, base: int, salt: int, links: Links | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent pairs once: the new sequence, its live places and the round's rules, one (left, right) per row.

    Pairs are counted in hash slots. Every pair that is more frequent than those
    it overlaps is replaced at the same time; a slot serves one pair only, and
    ``salt`` deals the pairs to other slots. ``live`` are the places, ascending,
    whose pair may be frequent: a pair in a rare slot is rare and stays so, hence
    only frequent slots and the surroundings of new symbols are looked at again.
    With ``links`` the sequence is changed in place and places that go are unlinked.
    """
    slots, everywhere = 1 << SLOT_BITS, links is None and live.size == seq.size - 1
    left, right = (seq[:-1], seq[1:]) if everywhere else (seq[live], seq[live + 1 if links is None else links.after[live]])
    slot = ((left * np.uint32(2654435761 + 2 * salt) + right * np.uint32(2246822519)) >> np.uint32(32 - SLOT_BITS)).astype(np.intp)
    here = np.bincount(slot)[slot].astype(np.int32)
    often = np.flatnonzero(here >= LEAST_USES)
    kept, here = live[often], here[often]
    # the place past the end, which is also place -1, has no pair
    near = np.zeros(seq.size + 1, dtype=np.int32) if links is None else links.near
    near[kept] = here
    prior, following = (kept - 1, kept + 1) if links is None else (links.before[kept], links.after[kept])
    best = often[(here > near[prior]) & (here >= near[following])]
    if links:
        near[kept] = 0
    of_best, left_best, right_best = slot[best], left[best], right[best]
    owner = np.empty(slots, dtype=np.intp)
    owner[of_best] = best
    first = owner[of_best]
    same = (left[first] == left_best) & (right[first] == right_best)
    best, of_best = best[same], of_best[same]
    uses = np.bincount(of_best, minlength=slots)
    enough = uses[of_best] >= LEAST_USES
    best, of_best = best[enough], of_best[enough]
    if best.size == 0:
        return seq, kept, np.zeros((0, 2), dtype=np.uint32)
    ruled = np.flatnonzero(uses >= LEAST_USES)
    name = np.empty(slots, dtype=np.uint32)
    name[ruled] = np.arange(base, base + ruled.size, dtype=np.uint32)
    rules = np.stack([left[owner[ruled]], right[owner[ruled]]], axis=1)
    at, again = live[best], np.zeros(seq.size + 1, dtype=bool) if links is None else links.again
    if links is None:
        out, keep = seq.copy(), np.ones(seq.size, dtype=bool)
        out[at] = name[of_best]
        keep[at + 1] = False
        again[kept] = again[at] = again[np.maximum(at - 1, 0)] = True
        return out[keep], np.flatnonzero(again[:-1][keep][:-1]), rules
    gone = links.after[at]
    following = links.after[gone]
    seq[at], links.after[at], links.before[following], links.left[gone] = name[of_best], following, at, False
    again[kept] = again[at] = again[links.before[at]] = True
    again[gone] = again[-1] = False
    places = np.flatnonzero(again)
    again[places] = False
    return seq, places[links.after[places] < seq.size], rules


def compress(ids: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules and the rules' expansion lengths of ``ids`` (unsigned 32-bit, below ``BASE``).

    Goes on until two rounds in a row, with their pairs dealt to different slots,
    make no rule; ``rounds`` ends it earlier. Once most places are no longer live,
    the sequence is linked, so that a round's time follows its live places.
    """
    seq, rules, made, idle, links = ids.astype(np.uint32), [np.zeros((0, 2), dtype=np.uint32)], 0, 0, None
    live = np.arange(max(seq.size - 1, 0))
    for turn in count() if rounds is None else range(rounds):
        if seq.size < 2 or idle == 2:
            break
        if links is None and live.size < seq.size // 4:
            links = Links(seq.size)
        seq, live, new = _pair_round(seq, live, BASE + made, turn, links)
        idle = 0 if len(new) else idle + 1
        rules.append(new)
        made += len(new)
    if links:
        seq = seq[links.left]
    lengths = np.zeros(0, dtype=np.int64)
    for new in rules:
        lengths = np.concatenate([lengths, _lengths_of(new.ravel(), lengths).reshape(-1, 2).sum(axis=1)])
    return seq, np.concatenate(rules), lengths.astype(np.uint32)


def _lengths_of(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.ones(symbols.size, dtype=np.int64)
    long = symbols >= BASE
    out[long] = lengths[symbols[long] - BASE]
    return out


def _expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids of ``symbols``: each is given its place among the ids, and only symbols that still stand for rules are opened on."""
    size = _lengths_of(symbols, lengths)
    place = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint32)
    while symbols.size:
        long = symbols >= BASE
        done = ~long
        out[place[done]] = symbols[done]
        pair, place = rules[symbols[long] - BASE], place[long]
        left = np.ascontiguousarray(pair[:, 0])
        symbols, place = np.concatenate([left, pair[:, 1]]), np.concatenate([place, place + _lengths_of(left, lengths)])
    return out


def decode_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a block; only the symbols that cover them are opened."""
    if count <= 0:
        return np.zeros(0, dtype=np.uint32)
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(_lengths_of(symbols, lengths))
    a, b = np.searchsorted(ends, [first, first + count - 1], side="right")
    skipped = first - (int(ends[a - 1]) if a else 0)
    return _expand(symbols[a : b + 1], rules, lengths)[skipped : skipped + count]


def write_token_file(reports: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Encode every whole report and write the block table to ``path``, in ascending ``procurement_id`` order.

    A null text is an empty report: its end id alone. Equal ids are ordered by
    text, a null id comes first; repeated rows are kept. Reports are range
    partitioned once; a task streams its range into blocks of ``BLOCK_IDS`` ids
    (a longer report is one block), so memory does not grow with the input.
    """
    kept = reports.select("procurement_id", F.coalesce("report_text", F.lit("")).alias("report_text"))
    kind = kept.schema["procurement_id"].dataType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_ids", T.LongType()),
        T.StructField("symbols", T.BinaryType()), T.StructField("rules", T.BinaryType()), T.StructField("lengths", T.BinaryType()),
        T.StructField("ids", T.ArrayType(kind)), T.StructField("ends", T.ArrayType(T.LongType())),
    ])
    spark = reports.sparkSession
    model, end = spark.sparkContext.broadcast(tokenizer_text(tokenizer_path)), np.array([end_id], dtype="<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = chunk_encoder(model.value).encode_all, TaskContext.get().partitionId()
        keys: list = []
        parts: list[bytes] = []
        ends: list[int] = []
        held = block = 0

        def flush() -> pa.RecordBatch:
            symbols, rules, lengths = compress(np.frombuffer(b"".join(parts), dtype="<u4"))
            key_type = pa.list_(id_type)
            columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64())]
            columns += [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (symbols, rules, lengths)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([keys], key_type), pa.array([ends], pa.list_(pa.int64()))], names=schema.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                keys.append(key)
                parts += (ids, end)
                held += len(ids) // 4 + 1
                ends.append(held)
                if held >= BLOCK_IDS:
                    yield flush()
                    keys, parts, ends, held, block = [], [], [], 0, block + 1
        if keys:
            yield flush()

    ordered = kept.repartitionByRange("procurement_id").sortWithinPartitions("procurement_id", "report_text")
    ordered.mapInArrow(blocks, schema).write.mode("overwrite").parquet(path)


def read_token_file(spark, path: str) -> DataFrame:
    """Read a block table back: ``procurement_id, start, n_tokens, ids_crc32`` per report, ``start`` over all reports.

    Every report is decoded from its block. The block totals that give the
    starts are a few numbers per million ids.
    """
    blocks = spark.read.parquet(path)
    sizes = blocks.select("shard", "block", "n_ids")
    of_shard = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_shard"))
    before = of_shard.select("shard", (F.sum("n_shard").over(Window.orderBy("shard")) - F.col("n_shard")).alias("before"))
    base = sizes.join(before, "shard").select(
        "shard", "block", (F.col("before") + F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("base")
    )
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("procurement_id", kind),
        T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, _, *blobs, keys, ends = (batch.column(i)[row] for i in range(batch.num_columns))
                symbols, rules, lengths = (np.frombuffer(x.as_buffer(), dtype="<u4") for x in blobs)
                ids = decode_range(symbols, rules.reshape(-1, 2), lengths, 0, int(ends.values[-1].as_py())).astype("<u4")
                stop = ends.values.to_numpy()
                start = np.concatenate([[0], stop[:-1]])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(start, stop)]
                n = len(crc)
                columns = [pa.repeat(shard, n), pa.repeat(block, n), keys.values, pa.array(start, pa.int64()), pa.array(stop - start, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = blocks.select("shard", "block", "n_ids", "symbols", "rules", "lengths", "ids", "ends").mapInArrow(decode, schema)
    return found.join(base, ["shard", "block"]).select("procurement_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file_folder(spark) -> str:
    """Folder for token files in the session's shared folder."""
    return f"{shared_folder(spark)}/token-ids"
