"""Toxicity of report texts by a classifier chain over chosen words and word beginnings."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = re.compile(r"\w+")
TRAINING_ROWS = 20_000
FEATURES = 400
FOLDS = 4
ROUNDS = 300
PENALTY = 5e-5
# A word also counts by its first letters, so that inflected forms count together.
BEGINNINGS = (4, 5)


@dataclass(frozen=True)
class ChainModel:
    """Chain of linear models: the known words, and per category the weights of the words, of earlier categories and the constant."""

    categories: tuple[str, ...]
    words: tuple[str, ...]
    weights: tuple[np.ndarray, ...]


def features_of(text: str | None) -> set[str]:
    """Different words of a text, lower-cased, and their beginnings with a ``^`` in front."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words.union(*({f"^{w[:n]}" for w in words if len(w) > n} for n in BEGINNINGS))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(row: np.ndarray, feature: np.ndarray, value: np.ndarray, width: int, target: np.ndarray) -> np.ndarray:
    """Logistic regression by accelerated descent with a step per feature; the last weight is the constant.

    ``row, feature, value`` are the non-zero cells of the data.
    """
    n = target.size
    if not n:
        return np.zeros(width + 1)
    row, feature, value = np.concatenate([row, np.arange(n)]), np.concatenate([feature, np.full(n, width)]), np.concatenate([value, np.ones(n)])
    reach = np.bincount(row, weights=np.abs(value), minlength=n)
    bound = 0.25 * np.bincount(feature, weights=np.abs(value) * reach[row], minlength=width + 1) / n + PENALTY
    weight = ahead = np.zeros(width + 1)
    momentum = 1.0
    for _ in range(ROUNDS):
        p = _logistic(np.bincount(row, weights=value * ahead[feature], minlength=n))
        slope = np.bincount(feature, weights=value * (p - target)[row], minlength=width + 1) / n + PENALTY * ahead
        slope[width] -= PENALTY * ahead[width]
        new = ahead - slope / bound
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, weight, momentum = new + (momentum - 1) / following * (new - weight), new, following
    return weight


def _cells(words: pd.Series, earlier: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Non-zero cells of word lists and of earlier probabilities, whose features come after the words."""
    sizes = np.fromiter(map(len, words), dtype=np.intp, count=len(words))
    row = np.repeat(np.arange(len(words)), sizes)
    feature = np.concatenate([np.asarray(w, dtype=np.int64) for w in words]) if len(words) else np.zeros(0, dtype=np.int64)
    rows, features, values = [row], [feature], [np.ones(row.size)]
    for i, name in enumerate(earlier.columns):
        rows.append(np.arange(len(words)))
        features.append(np.full(len(words), FEATURES + i))
        values.append(earlier[name].to_numpy(dtype=float))
    return np.concatenate(rows), np.concatenate(features), np.concatenate(values), FEATURES + earlier.shape[1]


def _word_sets(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(features_of(t)))

    return words(text)


def train_chain(reports: DataFrame, categories: tuple[str, ...], training_rows: int = TRAINING_ROWS) -> ChainModel:
    """Fit a chain on reports with ``procurement_id, report_text`` and a 0/1 column per category, in the given order.

    Only rows with every category are used, about ``training_rows`` of them,
    chosen by a hash of the id. The ``FEATURES`` words and word beginnings whose
    presence tells most about the categories are the features. Each model also sees the probabilities
    of the earlier categories; while training these are out of fold, so a later
    model learns how far an earlier one can be trusted. A fold's model takes its
    words, too, from the other folds' rows only. The models of all folds
    are fitted side by side, each from the bounded sample. Without rows the chain
    gives 0 for everything.
    """
    labelled = reports.select("procurement_id", "report_text", *categories).dropna(subset=list(categories))
    total = labelled.count()
    if not total:
        return ChainModel(tuple(categories), (), tuple(np.concatenate([np.zeros(FEATURES + i), [-30.0]]) for i in range(len(categories))))
    share = min(1.0, training_rows / total)
    sample = labelled.where(F.pmod(F.xxhash64("procurement_id"), F.lit(1_000_000)) < share * 1_000_000)
    fold = F.pmod(F.xxhash64("procurement_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    lists = written(sample.select(F.monotonically_increasing_id().alias("at"), fold.alias("fold"), _word_sets(F.col("report_text")).alias("words"), *(F.col(c).cast("double").alias(c) for c in categories)))
    chosen = _choose_words(lists, categories)
    numbers = [{w: i for i, w in enumerate(words)} for words in chosen]

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def known(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: [[number[w] for w in ws if w in number] for number in numbers])

    rows = written(lists.withColumn("words", known(F.col("words"))))
    weights: list[np.ndarray] = []
    for i, category in enumerate(categories):
        earlier = [f"p{j}" for j in range(i)]
        fitted = _fit_folds(rows, category, earlier)
        whole = fitted.where(F.col("fold") == FOLDS).select("weights").first()
        weights.append(np.array(whole["weights"]))
        if i + 1 < len(categories):
            held = fitted.where(F.col("fold") < FOLDS).select(F.explode(F.arrays_zip("at", "p")).alias("x")).select("x.at", F.col("x.p").alias(f"p{i}"))
            rows = written(rows.join(held, "at"))
    return ChainModel(tuple(categories), tuple(chosen[FOLDS]), tuple(weights))


def _models() -> Column:
    """A row for each fold's model; model ``FOLDS`` is the one of all rows."""
    return F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("model")


def _choose_words(lists: DataFrame, categories: tuple[str, ...]) -> list[list[str]]:
    """Per model the words by how far their documents' share of any category lies from the overall share, in standard errors.

    A fold's model counts the rows of the other folds only. Equally far words go in ascending order.
    """
    sums = [F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in categories)]
    folds = lists.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in categories))
    words = lists.select("fold", F.explode("words").alias("word"), *categories).groupBy("fold", "word").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in categories))
    others = F.col("fold") != F.col("model")
    overall = folds.select("*", _models()).where(others).groupBy("model").agg(*sums)
    seen = words.select("*", _models()).where(others).groupBy("model", "word").agg(*sums).where("n >= 5")
    shares = seen.join(overall.select("model", *((F.col(c) / F.col("n")).alias(f"all_{c}") for c in categories)), "model")
    far = [
        F.abs(F.col(c) / F.col("n") - F.col(f"all_{c}")) * F.sqrt("n") / F.greatest(F.sqrt(F.col(f"all_{c}") * (1 - F.col(f"all_{c}"))), F.lit(1e-3))
        for c in categories
    ]
    ranked = shares.select("model", "word", F.greatest(*far, F.lit(0.0)).alias("far"))
    best = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("far"), "word"))).where(F.col("rank") <= FEATURES)
    chosen: list[list[str]] = [[] for _ in range(FOLDS + 1)]
    for r in best.orderBy("model", "rank").collect():
        chosen[r["model"]].append(r["word"])
    return chosen


def _fit_folds(rows: DataFrame, category: str, earlier: list[str]) -> DataFrame:
    """One row per fold model: its weights, and the probabilities of the rows it has not seen. Fold ``FOLDS`` has seen all."""
    dealt = rows.select("*", _models()).select("model", "at", "fold", F.get("words", F.col("model")).alias("words"), F.col(category).alias("target"), *earlier)

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        out = (group["fold"] == key[0]).to_numpy()
        train, held = group[~out], group[out]
        row, feature, value, width = _cells(train["words"], train[earlier])
        weights = fit_linear(row, feature, value, width, train["target"].to_numpy())
        row, feature, value, width = _cells(held["words"], held[earlier])
        p = _logistic(np.bincount(row, weights=value * weights[feature], minlength=len(held)) + weights[width])
        return pd.DataFrame({"fold": [key[0]], "weights": [weights.tolist()], "at": [held["at"].tolist()], "p": [p.tolist()]})

    return written(dealt.groupBy("model").applyInPandas(fit, "fold int, weights array<double>, at array<long>, p array<double>"))


def probabilities(text: Column, model: ChainModel) -> Column:
    """Array of the chain's probabilities for a text, in category order; a null text counts as empty.

    Whole texts are read; a word counts once however often it stands there.
    """
    number = {w: i for i, w in enumerate(model.words)}

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pd.Series) -> pd.Series:
        found = texts.map(lambda t: [number[w] for w in number.keys() & features_of(t)])
        row = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), dtype=np.intp, count=len(found)))
        feature = np.array([f for fs in found for f in fs], dtype=np.int64)
        given: list[np.ndarray] = []
        for weights in model.weights:
            z = np.bincount(row, weights=weights[feature], minlength=len(found)) + weights[-1]
            for i, p in enumerate(given):
                z = z + weights[FEATURES + i] * p
            given.append(_logistic(z))
        return pd.Series(list(np.stack(given, axis=1)) if len(found) else [], dtype=object)

    return score(text)


def score_toxicity(reports: DataFrame, model: ChainModel, threshold: float = 0.5) -> DataFrame:
    """``procurement_id``, ``p_<category>`` for each category, and ``toxic``: whether the last one reaches ``threshold``.

    One row per input row, in one pass without a shuffle.
    """
    scored = reports.select("procurement_id", probabilities(F.col("report_text"), model).alias("p"))
    named = [F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(model.categories)]
    return scored.select("procurement_id", *named, (F.col("p")[len(model.categories) - 1] >= threshold).alias("toxic"))
