import random

import corpus_pipeline
from pyspark.sql import functions as F

from tenderlake.llm import quality, queries

from .helpers import SF, SF_MORE
from .test_packing import brute, check
from .test_quality import brute as judge


def test_stages_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF_MORE)
        if name != "packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old, new = {r["doc_id"]: r for r in before.collect()}, after.collect()
        if name == "quality_rules":
            rows = [(r["doc_id"], r["text"], r["source"]) for r in old.values()]
            assert {r["doc_id"] for r in new} == {r[0] for r in judge(rows, quality.LEAST_DOCUMENTS, quality.MOST_SHARE) if r[-1]}
            assert all(r["n_chars"] == old[r["doc_id"]]["n_chars"] for r in new if r["text"] == old[r["doc_id"]]["text"])
        elif name == "toxicity":
            toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_MORE}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in new}
            bad = [i for i in old if toxic.get(i) == 1]
            clean = [i for i in old if toxic.get(i) == 0]
            assert sum(i in kept for i in bad) <= 0.1 * len(bad)
            assert sum(i in kept for i in clean) >= 0.98 * len(clean)
        elif name == "near_duplicates":
            assert {r["doc_id"] for r in new} == representatives(old)
        else:
            assert sorted((tuple(r)[:5] for r in new), key=repr) == brute([(r["doc_id"], r["text"]) for r in old.values()], 4096)
            check(new, 4096, most=1.01)
        before = after


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def representatives(old):
    """Smallest id of each group of documents linked by a similarity of 0.8."""
    keys = sorted(old)
    sets = [shingles(old[k]["text"] or "") for k in keys]
    label = list(range(len(keys)))
    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    seen = set()
    for members in by_shingle.values():
        seen.update((a, b) for n, a in enumerate(members) for b in members[n + 1 :])
    for a, b in seen:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            label[max(a, b)] = min(a, b)
    return {keys[i] for i in range(len(keys)) if label[i] == i}


def test_run_gives_the_last_stage(spark):
    assert queries.QUERIES["pipeline"](spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_documents(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    good = " ".join(rng.choices(words, k=60))
    rows = [(1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, good, None, None, None), (None, good + " end", "en", "a", 1), (3, None, "en", "a", 0), (4, "", None, "a", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("content", F.lit("clash")).withColumn("kept_id", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0
        docs = out
    assert [r["doc_id"] for r in docs.collect()] == [1]
    assert corpus_pipeline.packing_stage(spark, docs.where("false"), SF).count() == 0
