"""Near-duplicate reports by SimHash: key buckets, pivot distance tables, verification, components.

A pair within the radius lies in a common bucket (see ``block_keys`` and
``shingle_facts``). Inside a bucket each fingerprint has a row of precomputed
Hamming distances to fixed reference fingerprints. By the triangle inequality no
coordinate of two rows may differ by more than the radius; pairs whose rows do
are discarded without looking at the fingerprints, survivors are verified.
Crowded buckets are cut into tiles which meet pairwise in different tasks, and a
task reports only links that join two parts, so a bucket of g members gives
fewer than g links per tile pair, never all pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.groups import components
from ..session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS = 3
BLOCKS = 6
TILE = 1024
PIVOTS = 16
SEED = 42
CHUNK = 1 << 15

# Wide search: fingerprints of WIDE_WORDS x 64 bits over shingles of five words.
WIDE_WORDS = 4
WIDE_SHINGLE = 5
WIDE_RADIUS = 56
SIMILARITY = 0.8
BANDS = 14
BAND_MINIMA = 4
# Distinct shingles up to which the wide fingerprint says little; such texts meet by band keys alone too.
SHORT_TEXT = 20
# Most shingles of a tile, and most 64-bit words of the table in which sets are compared.
TILE_SHINGLES = 2_000_000
TABLE_WORDS = 1 << 22


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``size``-word shingles of ``text``, A-Z lower-cased, repeats included.

    Fewer words give the whole sequence as one shingle, no words none.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - size + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in more than half of ``hashes``."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, hashes.size, CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > hashes.size, bitorder="little").view(np.uint64)[0])


def report_fingerprints(reports: DataFrame, size: int = 3) -> DataFrame:
    """``procurement_id, fingerprint`` (a long holding the 64 bits) of every whole report; a null text is empty."""
    kept = reports.select("procurement_id", "report_text")
    schema = T.StructType([T.StructField("procurement_id", kept.schema["procurement_id"].dataType), T.StructField("fingerprint", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([majority(shingle_hashes(t, size)) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=schema.names)

    return kept.mapInArrow(read, schema)


def block_keys(fingerprint: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """Bucket keys of a 64-bit fingerprint: its bits in every choice of ``blocks - radius`` of the blocks.

    Two fingerprints that differ in at most ``radius`` bits agree in all bits of
    at least so many blocks, so they share a key.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return F.array(*(F.xxhash64(F.lit(i), fingerprint.bitwiseAND(F.lit(mask))) for i, mask in enumerate(masks)))


def _references(words: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, size=(PIVOTS, words), dtype=np.uint64)


def bucket_links(group: np.ndarray, tile: np.ndarray, crossing: np.ndarray, bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links inside each group that suffice to connect all its pairs within ``radius``, as row numbers.

    ``bits`` holds a fingerprint per row. In a crossing group only rows of
    different tiles are compared. Rows are ordered by group and distance to the
    first reference, so row i meets row i + 1, i + 2, ... until that distance
    alone tells them apart.
    """
    table = np.stack([np.bitwise_count(bits ^ ref).sum(axis=1, dtype=np.int16) for ref in _references(bits.shape[1])], axis=1)
    order = np.lexsort((table[:, 0], group))
    group, tile, crossing, bits, table = group[order], tile[order], crossing[order], bits[order], table[order]
    near = table[:, 0]
    label = np.arange(group.size)
    links: list[tuple[int, int]] = []
    at, step = np.arange(group.size), 0
    while at.size:
        step += 1
        at = at[at + step < group.size]
        at = at[(group[at] == group[at + step]) & (near[at + step] - near[at] <= radius)]
        here = at[(~crossing[at] | (tile[at] != tile[at + step])) & (label[at] != label[at + step])]
        here = here[np.abs(table[here] - table[here + step]).max(axis=1, initial=0) <= radius]
        here = here[np.bitwise_count(bits[here] ^ bits[here + step]).sum(axis=1, dtype=np.int16) <= radius]
        for a in here.tolist():
            x, y = a, a + step
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            if x != y:
                label[max(x, y)] = min(x, y)
                links.append((int(order[a]), int(order[a + step])))
        if here.size:
            while not np.array_equal(label, label[label]):
                label = label[label]
    return links


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that connect all points within ``radius`` which share a key.

    ``points``: ``point`` (a unique long), ``fingerprint`` (array of longs) and
    ``keys`` (array of longs). Buckets are counted before anything is paired;
    those of one member go. A bucket of more than ``TILE`` members is cut into
    tiles by hash, and each pair of tiles is a work item of its own, so no task
    holds a whole bucket and none is cut off.
    """
    keyed = points.select("point", "fingerprint", F.explode(F.array_distinct("keys")).alias("key"))
    busy = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    # Spark sizes the keyed rows as if each point had one key, so it would broadcast all of them
    met = keyed.join(busy.hint("merge"), "key").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("point", F.lit("tile")), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    items = met.withColumn("other", other).select(
        "key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "point", "fingerprint"
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def solve(parts: list[np.ndarray]) -> pa.RecordBatch:
            key, t1, t2, tile, point, bits = parts
            new = np.ones(key.size, dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
            found = np.array(bucket_links(np.cumsum(new), tile, t1 != t2, bits, radius), dtype=np.intp).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(point[found[:, 0]]), pa.array(point[found[:, 1]])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bits = batch.column(5).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            parts = [*(batch.column(i).to_numpy() for i in range(5)), bits]
            if kept is not None:
                parts = [np.concatenate(pair) for pair in zip(kept, parts)]
            key, t1, t2 = parts[:3]
            last = np.flatnonzero((key != key[-1]) | (t1 != t1[-1]) | (t2 != t2[-1]))
            cut = int(last[-1]) + 1 if last.size else 0
            if cut:
                yield solve([p[:cut] for p in parts])
            kept = [p[cut:] for p in parts]
        if kept is not None:
            yield solve(kept)

    sorted_items = items.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    return sorted_items.mapInArrow(link, "a long, b long").distinct()


def group_by_fingerprint(reports: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``procurement_id, fingerprint, component_id`` of every report, one row per input row.

    Reports whose fingerprints over shingles of three words differ in at most
    ``radius`` bits are linked; ``component_id`` is the smallest id that links
    reach (null ids never are, unless there is no other). ``fingerprint`` has 16
    hex digits. Equal fingerprints become one point before the search, so copies
    cost one row each. The search is exact: no pair within the radius is lost.
    """
    prints = written(report_fingerprints(reports))
    points = written(prints.groupBy("fingerprint").agg(F.min("procurement_id").alias("first_id")))
    keyed = points.select(F.col("fingerprint").alias("point"), F.array("fingerprint").alias("fingerprint"), block_keys(F.col("fingerprint"), radius).alias("keys"))
    linked = components(near_links(keyed, radius))
    place = points.join(linked.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"), "first_id"
    )
    least = place.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = place.join(least, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("procurement_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_facts(text: str | None) -> tuple[list[int], list[int], np.ndarray]:
    """Wide fingerprint, band keys and distinct shingle hashes of a text, for five words.

    Too many bits may differ for block keys, so buckets come from the smallest
    shingle hashes under many orders: ``BAND_MINIMA`` of them make a key, and two
    texts of similarity 0.8 share one of ``BANDS`` keys with probability 0.999.
    """
    hashes = np.unique(shingle_hashes(text, WIDE_SHINGLE))
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 63, size=WIDE_WORDS + BANDS * BAND_MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = [(hashes ^ (hashes >> np.uint64(29))) * f for f in factors]
    mixed = [m ^ (m >> np.uint64(32)) for m in mixed]
    wide = [majority(m * np.uint64(0x9E3779B97F4A7C15) ^ (m >> np.uint64(7))) for m in mixed[:WIDE_WORDS]]
    least = np.array([int((m * np.uint64(0x9E3779B97F4A7C15)).min()) if m.size else 0 for m in mixed[WIDE_WORDS:]], dtype=np.uint64).reshape(BANDS, BAND_MINIMA)
    keys = np.zeros(BANDS, dtype=np.uint64)
    for i in range(BAND_MINIMA):
        keys = (keys ^ least[:, i]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    keys += np.arange(BANDS, dtype=np.uint64)
    signed = np.array(wide, dtype=np.uint64).view(np.int64).tolist()
    return signed, keys.view(np.int64).tolist(), hashes


LONGS = T.ArrayType(T.LongType())


@F.pandas_udf(T.StructType([T.StructField("fingerprint", LONGS), T.StructField("keys", LONGS), T.StructField("shingles", T.LongType())]))
def _facts(texts: pd.Series) -> pd.DataFrame:
    found = [shingle_facts(t) for t in texts]
    return pd.DataFrame({"fingerprint": [f for f, _, _ in found], "keys": [k for _, k, _ in found], "shingles": [h.size for _, _, h in found]})


def _short_points(points: DataFrame) -> DataFrame:
    """Short texts once more, under keys of their own and one fingerprint, so that no radius parts them."""
    short = points.where(F.col("facts.shingles") <= SHORT_TEXT)
    keys = F.transform("facts.keys", lambda k: F.xxhash64(k, F.lit("short")))
    return short.select(F.col("content").alias("point"), F.array_repeat(F.lit(0).cast("long"), WIDE_WORDS).alias("fingerprint"), keys.alias("keys"))


@F.pandas_udf(LONGS)
def _shingles(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: shingle_facts(t)[2].view(np.int64))


def true_links(tile: np.ndarray, crossing: bool, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of a Jaccard similarity of at least ``SIMILARITY`` that suffice to connect all such pairs, as row numbers.

    ``sets`` holds the distinct shingle hashes of each row. In a crossing item only
    rows of different tiles are compared. Two rows are passed over only if pairs that
    passed the check connect them already. Rows are ordered by size, as a pair's
    sizes differ by a fifth at most.
    """
    order = np.argsort([s.size for s in sets], kind="stable")
    sets, tile = [sets[i] for i in order], tile[order]
    size = np.array([s.size for s in sets], dtype=np.int64)
    _, code, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a shingle of one row is in no intersection
    common = uses[code] > 1
    row, code = np.repeat(np.arange(size.size), size)[common], (np.cumsum(uses > 1) - 1)[code[common]]
    width = (int((uses > 1).sum()) + 63) // 64
    table = None
    if size.size * width <= TABLE_WORDS:
        table = np.zeros((size.size, width), dtype=np.uint64)
        np.bitwise_or.at(table, (row, code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
    first = np.searchsorted(row, np.arange(size.size + 1))
    label = np.arange(size.size)
    links: list[tuple[int, int]] = []
    for i, last in enumerate(np.searchsorted(size, size / SIMILARITY + 1, side="right").tolist()):
        others = np.arange(i + 1, last)
        others = others[(label[others] != label[i]) & (not crossing or tile[others] != tile[i])]
        if not others.size:
            continue
        if table is not None:
            shared = np.bitwise_count(table[others] & table[i]).sum(axis=1, dtype=np.int64)
        else:
            mine = np.zeros(width * 64, dtype=bool)
            mine[code[first[i] : first[i + 1]]] = True
            span = slice(first[i + 1], first[last])
            shared = np.bincount(row[span][mine[code[span]]], minlength=size.size)[others]
        for j in others[shared >= SIMILARITY * (size[i] + size[others] - shared)].tolist():
            if label[i] != label[j]:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
                links.append((int(order[i]), int(order[j])))
    return links


def checked_links(members: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all members of a component whose sets have a Jaccard similarity of at least ``SIMILARITY``.

    ``members``: ``content`` (a unique long), ``component`` and ``shingles``. A
    component of more than ``TILE`` members or ``TILE_SHINGLES`` shingles is cut into
    tiles by hash, and each pair of tiles is a work item of its own that holds the
    sets of its members.
    """
    weight = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("total"))
    tiles = weight.select("component", F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("total") / TILE_SHINGLES), F.lit(1)).cast("int").alias("tiles"))
    placed = members.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("content", F.lit("tile")), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    items = placed.withColumn("other", other).select(
        "component", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "content", "shingles"
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def solve() -> pa.RecordBatch:
            content = [c for _, c, _ in held]
            found = true_links(np.array([t for t, _, _ in held]), at[1] != at[2], [s for _, _, s in held]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([content[i] for i, _ in found], pa.int64()), pa.array([content[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            component, t1, t2, tile, content = (batch.column(i).to_pylist() for i in range(5))
            flat, ends = batch.column(5).flatten().to_numpy(), np.cumsum(batch.column(5).value_lengths().to_numpy())
            for i, item in enumerate(zip(component, t1, t2)):
                if item != at:
                    if held:
                        yield solve()
                    at, held = item, []
                held.append((tile[i], content[i], flat[ends[i - 1] if i else 0 : ends[i]]))
        if held:
            yield solve()

    sorted_items = items.repartition("component", "t1", "t2").sortWithinPartitions("component", "t1", "t2")
    return sorted_items.mapInArrow(link, "a long, b long")


def similar_groups(reports: DataFrame) -> DataFrame:
    """``content, first_id, component_id, leads``: each distinct text's smallest id, that of its group, and whether it stands for the group.

    Texts are linked if their sets of five-word shingles have a Jaccard
    similarity of at least 0.8. Wide fingerprints within ``WIDE_RADIUS`` bits that
    share a band key are candidates; of two short texts the band key is enough. The components of the candidates are only
    where the search goes on: inside each of them texts are linked by their shingle
    sets alone. ``content`` is a 64-bit hash of the text; a null text is empty.
    """
    text = F.coalesce("report_text", F.lit(""))
    contents = reports.select("procurement_id", F.xxhash64(text).alias("content"), _facts(text).alias("facts"))
    points = written(
        contents.groupBy("content").agg(F.min("procurement_id").alias("first_id"), F.any_value("facts").alias("facts"))
    )
    wide = points.select(F.col("content").alias("point"), "facts.fingerprint", "facts.keys")
    near = components(near_links(wide.unionByName(_short_points(points)), WIDE_RADIUS))
    loose = written(near.select(F.col("id").alias("of"), "component"))
    # one report speaks for its copies, so a text with many copies is not gathered in one task
    chosen = points.join(loose, F.col("content") == F.col("of")).select("of", "first_id")
    own = reports.select("procurement_id", F.xxhash64(text).alias("content"), text.alias("report_text"))
    texts = own.join(chosen, (F.col("content") == F.col("of")) & F.col("procurement_id").eqNullSafe(F.col("first_id")), "left_semi").dropDuplicates(["content"])
    sets = texts.select("content", _shingles(F.col("report_text")).alias("shingles"))
    members = written(sets.join(loose, F.col("content") == F.col("of")).select("content", "component", "shingles"))
    linked = components(checked_links(members))
    place = points.join(linked.withColumnRenamed("id", "content"), "content", "left").select(
        "content", F.coalesce("component", "content").alias("component"), "first_id"
    )
    first = F.min(F.struct(F.col("first_id").isNull(), "first_id", "content"))
    least = place.groupBy("component").agg(first.alias("lead"))
    return place.join(least, "component").select("content", "first_id", F.col("lead.first_id").alias("component_id"), (F.col("content") == F.col("lead.content")).alias("leads"))
