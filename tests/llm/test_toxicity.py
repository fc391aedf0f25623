import random

import numpy as np

from tenderlake.llm import queries, toxicity

from .helpers import SF, SF_MORE, documents, empty_reports, odd_reports


def test_known_labels(spark):
    found = {r["doc_id"]: r["toxic"] for r in queries.op2_toxicity_chain(spark, SF_MORE).collect()}
    labels = spark.read.parquet(f"{SF_MORE}/labels.parquet").collect()
    toxic = [r["doc_id"] for r in labels if r["toxic"] == 1]
    clean = [r["doc_id"] for r in labels if r["toxic"] == 0]
    assert sum(found[i] for i in toxic) >= 0.9 * len(toxic)
    assert sum(found[i] for i in clean) <= 0.02 * len(clean)


def test_later_category_uses_earlier_one(spark):
    """A second category that equals the first is learned from its out-of-fold probability."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)) + (" slur" if i % 3 == 0 else ""), int(i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    reports = spark.createDataFrame(rows, "procurement_id long, report_text string, rude int, toxic int")
    model = toxicity.train_chain(reports, ("rude", "toxic"))
    assert model.weights[1][toxicity.FEATURES] > 0.5
    found = {r["procurement_id"]: r["toxic"] for r in toxicity.score_toxicity(reports, model).collect()}
    assert all(found[i] == (i % 3 == 0) for i, *_ in rows)


def test_inflected_stems_are_learned(spark):
    """Toxic rows share a stem that never stands alone; half of the rows are held out."""
    rng = random.Random(6)
    plain = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(600):
        words = rng.choices(plain, k=40) + ([f"zqxv{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.randrange(100)}" for _ in range(3)] if i % 4 == 0 else [])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    reports = spark.createDataFrame(rows, "procurement_id long, report_text string, toxic int")
    model = toxicity.train_chain(reports.where("procurement_id < 300"), ("toxic",))
    found = {r["procurement_id"]: r["toxic"] for r in toxicity.score_toxicity(reports, model).collect()}
    assert sum(found[i] == (i % 4 == 0) for i in range(300, 600)) >= 280


def plain_words(rows, categories):
    n = len(rows)
    share = [sum(r[2][c] for r in rows) / n for c in range(categories)]
    words = {w for _, fs, _ in rows for w in fs}
    ranked = []
    for w in words:
        with_word = [r for r in rows if w in r[1]]
        if len(with_word) >= 5:
            far = max(
                abs(sum(r[2][c] for r in with_word) / len(with_word) - share[c]) * len(with_word) ** 0.5 / max((share[c] * (1 - share[c])) ** 0.5, 1e-3)
                for c in range(categories)
            )
            ranked.append((-round(far, 9), w))
    return [w for _, w in sorted(ranked)[: toxicity.FEATURES]]


def plain_fit(x, y):
    """Dense accelerated descent with the same steps and rounds."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], toxicity.PENALTY)
    bound = 0.25 * (np.abs(x) * np.abs(x).sum(axis=1, keepdims=True)).sum(axis=0) / len(x) + penalty
    penalty[-1] = 0
    weight = ahead = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(toxicity.ROUNDS):
        new = ahead - (x.T @ (1 / (1 + np.exp(-x @ ahead)) - y) / len(x) + penalty * ahead) / bound
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, weight = new + (before - 1) / t * (new - weight), new
    return weight


def plain_chain(rows, categories):
    """rows: (fold, features, labels); words and weights of every category's model of all rows, written down plainly."""
    folds = range(toxicity.FOLDS)
    words = [plain_words([r for r in rows if r[0] != m], categories) for m in (*folds, -1)]

    def dense(i, m, earlier):
        cells = np.zeros(toxicity.FEATURES + len(earlier))
        cells[[j for j, w in enumerate(words[m]) if w in rows[i][1]]] = 1
        cells[toxicity.FEATURES :] = [e[i] for e in earlier]
        return cells

    earlier, weights = [], []
    for c in range(categories):
        y = np.array([r[2][c] for r in rows], dtype=float)
        p = np.zeros(len(rows))
        for m in (*folds, -1):
            x = np.array([dense(i, m, earlier) for i in range(len(rows))])
            train = np.array([r[0] != m for r in rows])
            w = plain_fit(x[train], y[train])
            if m == -1:
                weights.append(w)
            else:
                p[~train] = 1 / (1 + np.exp(-(x[~train] @ w[:-1] + w[-1])))
        earlier.append(p)
    return words[-1], weights


def test_chain_against_plain_chain(spark):
    """Words, weights and probabilities equal those of a dense chain on the given labels; a word's fold never sees its own labels."""
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").dropna().collect()}
    texts = {r["doc_id"]: r["text"] for r in documents(spark) if r["doc_id"] in labels}
    given = [(i, t, int(labels[i]["quality"]), int(labels[i]["toxic"])) for i, t in texts.items()]
    reports = spark.createDataFrame(given, "procurement_id long, report_text string, quality int, toxic int")
    folds = {r[0]: r[1] for r in reports.selectExpr("procurement_id", f"cast(pmod(xxhash64(procurement_id, 'fold'), {toxicity.FOLDS}) AS int)").collect()}
    rows = [(folds[i], toxicity.features_of(t), labels) for i, t, *labels in given]
    words, weights = plain_chain(rows, 2)
    model = toxicity.train_chain(reports, ("quality", "toxic"))
    assert set(model.words) == set(words)
    place = [model.words.index(w) for w in words]
    rest = list(range(len(words), toxicity.FEATURES))
    for mine, plain in zip(model.weights, weights):
        order = [*place, *rest, *range(toxicity.FEATURES, len(plain))]
        assert np.allclose(mine[order], plain, atol=1e-3)
    found = {r["procurement_id"]: r for r in toxicity.score_toxicity(reports, model).collect()}
    for (i, *_), (_, features, _) in zip(given, rows):
        given_p = []
        for w in weights:
            z = w[-1] + sum(w[j] for j, word in enumerate(words) if word in features) + sum(a * b for a, b in zip(w[toxicity.FEATURES :], given_p))
            given_p.append(1 / (1 + np.exp(-z)))
        assert np.allclose([found[i]["p_quality"], found[i]["p_toxic"]], given_p, atol=1e-3)


def test_clashing_labels(spark, tmp_path):
    """Of several labels of one document the largest of each category counts, whatever their order."""
    docs = spark.createDataFrame([(i, "good text here" + (" slur" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2, i % 2) for i in range(60)] + [(i, 0, 0) for i in range(60)] + [(1, None, 1)]
    models = []
    for name, order in (("a", labels), ("b", labels[::-1])):
        spark.createDataFrame(order, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        models.append(queries.chain_of(spark, docs, f"{tmp_path}/{name}"))
    assert models[0].words == models[1].words
    for model in models:
        found = toxicity.score_toxicity(docs.selectExpr("doc_id AS procurement_id", "text AS report_text"), model).collect()
        assert all(r["toxic"] == (r["procurement_id"] % 2 == 1) for r in found)


def test_fit_separates():
    row, feature = np.array([0, 1, 2, 3]), np.array([0, 0, 1, 1])
    weights = toxicity.fit_linear(row, feature, np.ones(4), 2, np.array([1.0, 1.0, 0.0, 0.0]))
    assert weights[0] > 1 and weights[1] < -1


def test_odd_rows_and_empty_tables(spark):
    nothing = toxicity.train_chain(empty_reports(spark).selectExpr("*", "1 AS rude"), ("rude",))
    rows = toxicity.score_toxicity(odd_reports(spark), nothing).collect()
    assert len(rows) == 13 and not any(r["toxic"] for r in rows)
    model = toxicity.train_chain(odd_reports(spark).selectExpr("*", "CASE WHEN report_text IS NULL THEN 1 ELSE 0 END AS rude"), ("rude",))
    assert toxicity.score_toxicity(odd_reports(spark), model).count() == 13
    assert toxicity.score_toxicity(empty_reports(spark), model).count() == 0
