import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tenderlake.llm import queries, simhash
from tenderlake.session import written

from .helpers import SF, SF_MORE, documents, empty_reports, odd_reports


def fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def brute(rows):
    prints = [(key, fingerprint(text)) for key, text in rows]
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    values = np.array([p for _, p in prints], dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted(((key, f"{p:016x}", least.get(root(i))) for i, (key, p) in enumerate(prints)), key=repr)


def test_documents_against_brute_force(spark):
    for root in (SF, SF_MORE):
        rows = [(r["doc_id"], r["text"]) for r in documents(spark, root)]
        assert sorted(map(tuple, queries.op5_simhash_pivots(spark, root).collect()), key=repr) == brute(rows)


def test_odd_rows_and_empty_tables(spark):
    frame = odd_reports(spark)
    rows = [(r["procurement_id"], r["report_text"]) for r in frame.collect()]
    assert sorted(map(tuple, simhash.group_by_fingerprint(frame).collect()), key=repr) == brute(rows)
    assert simhash.group_by_fingerprint(empty_reports(spark)).count() == 0


def crowd(n, seed):
    """Fingerprints in a dense cloud: most pairs share many keys."""
    rng = random.Random(seed)
    base = rng.getrandbits(64)
    out = {base}
    while len(out) < n:
        x = rng.choice(sorted(out)) if rng.random() < 0.5 else base
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def components_of(n, links):
    label = list(range(n))
    for a, b in links:
        while label[a] != a:
            a = label[a]
        while label[b] != b:
            b = label[b]
        label[max(a, b)] = min(a, b)
    for i in range(n):
        label[i] = label[label[i]]
        while label[label[i]] != label[i]:
            label[i] = label[label[i]]
    return label


def all_links(bits):
    return [(i, int(j)) for i in range(bits.size) for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 3) if j > i]


def test_bucket_links_connect_like_all_pairs():
    for seed in range(5):
        bits = crowd(300, seed)
        none = np.zeros(300, dtype=int)
        links = simhash.bucket_links(none, none, none.astype(bool), bits.reshape(-1, 1), 3)
        assert len(links) < 300
        assert components_of(300, links) == components_of(300, all_links(bits))


def test_crowded_buckets_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    bits = crowd(250, 11)
    frame = spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "point long")
    points = frame.select("point", simhash.F.array("point").alias("fingerprint"), simhash.block_keys(simhash.F.col("point")).alias("keys"))
    number = {int(b): i for i, b in enumerate(bits.view(np.int64))}
    links = [(number[r["a"]], number[r["b"]]) for r in simhash.near_links(points).collect()]
    assert components_of(250, links) == components_of(250, all_links(bits))


def test_wide_groups(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near, far = list(base), list(base)
    near[150] = "changed"
    for i in range(0, 300, 10):
        far[i] = "other"
    texts = [(5, " ".join(base)), (3, " ".join(near)), (2, " ".join(far)), (9, " ".join(base)), (4, " ".join(f"v{rng.randrange(5000)}" for _ in range(300)))]
    frame = spark.createDataFrame(texts, "procurement_id long, report_text string")
    found = simhash.similar_groups(frame).collect()
    assert sorted((r["first_id"], r["component_id"]) for r in found) == [(2, 2), (3, 3), (4, 4), (5, 3)]
    assert sorted(r["first_id"] for r in found if r["leads"]) == [2, 3, 4]
    assert simhash.similar_groups(odd_reports(spark)).count() == 9
    assert simhash.similar_groups(empty_reports(spark)).count() == 0


def star(copies, seed):
    """An original of 200 words and copies with three changed words: each at 0.8 or more to the original, few to each other."""
    rng = random.Random(seed)
    original = [f"{seed}w{i}" for i in range(200)]
    out = [" ".join(original)]
    for c in range(copies):
        words = list(original)
        for at in rng.sample(range(10, 190), 3):
            words[at] = f"c{c}x{at}"
        out.append(" ".join(words))
    return out


def groups_by_brute_force(texts):
    sets = [set(simhash.shingle_hashes(t, simhash.WIDE_SHINGLE).tolist()) for t in texts]
    true = [(a, b) for a, x in enumerate(sets) for b in range(a + 1, len(sets)) if len(x & sets[b]) >= 0.8 * len(x | sets[b])]
    return components_of(len(texts), true)


def test_stars_of_copies(spark, monkeypatch):
    texts = star(100, 1) + star(30, 2)
    want = groups_by_brute_force(texts)
    assert set(want) == {0, 101}
    frame = spark.createDataFrame(list(enumerate(texts)), "procurement_id long, report_text string")
    for tile, shingles in ((1024, 2_000_000), (16, 2_000_000), (1024, 3000)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "TILE_SHINGLES", shingles)
        found = sorted((r["first_id"], r["component_id"]) for r in simhash.similar_groups(frame).collect())
        assert found == list(enumerate(want))


def test_true_links_connect_like_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(45, 61)], rng.integers(0, 1 << 63, rng.integers(0, 8))])) for _ in range(120)]
    sets += [np.zeros(0, dtype=np.int64)] * 2
    true = [(a, b) for a in range(122) for b in range(a + 1, 122) if (n := np.intersect1d(sets[a], sets[b]).size) >= 0.8 * (sets[a].size + sets[b].size - n)]
    tile = np.arange(122) % 2
    for words in (simhash.TABLE_WORDS, 0):
        monkeypatch.setattr(simhash, "TABLE_WORDS", words)
        for crossing in (False, True):
            links = simhash.true_links(tile, crossing, sets)
            wanted = [(a, b) for a, b in true if not crossing or tile[a] != tile[b]]
            assert len(links) < 122 and {tuple(sorted(x)) for x in links} <= set(wanted)
            assert components_of(122, links) == components_of(122, wanted)


def test_native_hashes_agree(spark):
    """The shingle hash is Spark's own for one text column."""
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row["h"] % (1 << 64) == int(simhash.shingle_hashes("a b c", 3)[0])


def test_short_texts_are_not_parted_by_the_radius(spark):
    """Texts of nine and eight words share four of five shingles: similarity 0.8."""
    rng = random.Random(21)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "es", "um")]
    rows = []
    for i in range(300):
        text = rng.sample(words, 9)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:-1]))]
    found = {r["first_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "procurement_id long, report_text string")).collect()}
    assert sum(found[2 * i + 1] == found[2 * i] for i in range(300)) >= 298


def test_keyed_points_are_not_broadcast(spark):
    """A point has twenty keys, which Spark's size of the rows does not count, so all keyed rows were broadcast."""
    points = written(spark.range(2000).select(F.xxhash64("id").alias("point")))
    keyed = points.select("point", F.array("point").alias("fingerprint"), simhash.block_keys(F.col("point")).alias("keys"))
    assert "Broadcast" not in simhash.near_links(keyed)._jdf.queryExecution().executedPlan().toString()
