"""Toxicity by non-negative positive-unlabelled learning (operator 6).

Confirmed toxic documents are the positives; every other document is unlabelled, not clean.
With the class prior pi, the risk of a classifier g is

    pi * mean_P loss(g) + max(0, mean_U loss(-g) - pi * mean_P loss(-g)).

The second part estimates the loss on clean documents from unlabelled ones by taking out the
toxic share; where it falls below zero the classifier fits noise, and the step goes up that
part instead of down the whole (the non-negative correction).  The classifier is logistic over
the words and the word beginnings (four and five letters) that a document has, trained in numpy;
the model is the mean of the later half of the steps.

The sample that it is trained on is bounded: ``POSITIVES`` and ``UNLABELLED`` documents, the
first in the order of a hash of the id, whole texts.  Words and beginnings enter the model if the positives
hold them more often than the unlabelled by the G test (``G_LEAST``), at most ``WORDS`` of them.
The prior is the toxic share of the labelled documents that may be learnt from, or a parameter.

Scoring is one pass over whole texts in Arrow batches, no shuffle.

Defined cases: a null text is an empty one; an empty text, like one without a word of the model,
gets the score of the intercept; documents with conflicting label rows count as toxic; without a
toxic document to learn from, every score is 0; an empty table gives an empty result; rows with
a null id count as the empty id; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solera.llm.common import crc_mod, fitted, text_batches, text_of

POSITIVES = 1500
UNLABELLED = 4500
WORDS = 20000
G_LEAST = 16.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

_LETTERS = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> set[str]:
    words = set(_LETTERS.findall(text.lower()))
    return words | {w[:5] + "*" for w in words} | {w[:4] + "*" for w in words}


class Model:
    """weights: of the words; bias: None if nothing could be learnt."""

    def __init__(self, weights: dict[str, float], bias: float | None):
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        if self.bias is None:
            return 0.0
        get = self.weights.get
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum([get(w, 0.0) for w in words_in(text)]), -30, 30))))


def _g_test(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """G of a of n positives against b of m others that hold a word; 0 where a/n <= b/m."""
    share = (a + b) / (n + m)
    term = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0)
    g = 2 * (term(a, n * share) + term(n - a, n * (1 - share)) + term(b, m * share) + term(m - b, m * (1 - share)))
    return np.where(a * m > b * n, g, 0)


def _slope(z: np.ndarray, is_p: np.ndarray, prior: float) -> np.ndarray:
    """The derivative by each document's score z of the non-negative risk with logistic loss, or,
    where the part of the clean documents is negative, of its reverse."""
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    p, u = is_p.sum(), (~is_p).sum()
    d_pn, d_un = np.where(is_p, s / p, 0), np.where(is_p, 0, s / u)
    if np.logaddexp(0, z[~is_p]).mean() < prior * np.logaddexp(0, z[is_p]).mean():
        return prior * d_pn - d_un
    return prior * np.where(is_p, (s - 1) / p, 0) + d_un - prior * d_pn


def _descend(x: np.ndarray, slope, steps: int, rate: float) -> np.ndarray:
    """Adam; the mean of the later half of the steps."""
    m1, m2, late = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        g = slope(x)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        x = x - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        late += x * (step > steps // 2)
    return late / (steps - steps // 2)


def fit(positive: list[str], unlabelled: list[str], prior: float, steps: int = 300, rate: float = 0.05, decay: float = 0.02) -> Model:
    """Train on texts: the weights with strong decay, which orders documents well but keeps scores
    close to the prior, then one factor and one intercept by the same risk, which set the scale."""
    if not positive or not unlabelled:
        return Model({}, None)
    in_p, in_u = Counter(w for t in positive for w in words_in(t)), Counter()
    in_p = {w: k for w, k in in_p.items() if k > 1}
    for t in unlabelled:
        in_u.update(w for w in words_in(t) if w in in_p)
    seen = sorted(in_p)
    g = _g_test(np.array([in_p[w] for w in seen], float), len(positive), np.array([in_u[w] for w in seen], float), len(unlabelled))
    best = [seen[k] for k in sorted(np.flatnonzero(g >= G_LEAST), key=lambda k: (-g[k], seen[k]))[:WORDS]]
    at = {w: k for k, w in enumerate(best)}
    own = [np.array(sorted(at[w] for w in words_in(t) if w in at), np.int64) for t in [*positive, *unlabelled]]
    n = len(own)
    rows, cols = np.repeat(np.arange(n), [len(x) for x in own]), np.concatenate(own)
    is_p = np.arange(n) < len(positive)
    linear = lambda w: np.bincount(rows, w[cols], n)

    def slope(x: np.ndarray) -> np.ndarray:
        d = _slope(linear(x[:-1]) + x[-1], is_p, prior)
        return np.append(np.bincount(cols, d[rows], len(best)) + decay * prior * x[:-1], d.sum())

    def scale_slope(x: np.ndarray) -> np.ndarray:
        d = _slope(z * x[0] + x[1], is_p, prior)
        return np.array([(d * z).sum(), d.sum()])

    weights = _descend(np.append(np.zeros(len(best)), -2.0), slope, steps, rate)
    z = linear(weights[:-1]) + weights[-1]
    factor, intercept = _descend(np.array([1.0, 0.0]), scale_slope, steps, rate)
    return Model({x: float(v * factor) for x, v in zip(best, weights)}, float(weights[-1] * factor + intercept))


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, FOLDS) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """Fit on the bounded sample of the rows of ``docs`` that may be learnt from; ``labels`` has
    doc_id and toxic."""
    may = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.filter(~held_out(F.col("doc_id"))).select("doc_id").distinct().join(may, "doc_id", "left")
    known = known.select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"), F.col("toxic").isNotNull().alias("labelled"))
    toxic, labelled = known.agg(F.count_if("toxic"), F.count_if("labelled")).first()
    if prior is None:
        prior = toxic / labelled if labelled else 0.0
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = (known.filter("toxic").orderBy(*order).limit(positives)
           .unionByName(known.filter("not toxic").orderBy(*order).limit(unlabelled)).select("doc_id", "toxic"))
    text = docs.select("doc_id", text_of(F.col("text")).alias("text"))
    prior = min(max(prior, 1e-4), 0.9)

    def run(sample):
        sample = sample.sort_values(["doc_id", "text"]).drop_duplicates()
        toxic = sample["toxic"].astype(bool)
        return fit(sample.loc[toxic, "text"].tolist(), sample.loc[~toxic, "text"].tolist(), prior)

    return fitted(text.join(ids, "doc_id"), run)


def score_column(spark, text: Column, model: Model) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")
    return score(text_of(text))


def scored(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), in the place of any column of that name."""
    text_batches(docs.sparkSession)
    model = train(docs, labels, **kw)
    return docs.withColumn("score", score_column(docs.sparkSession, F.col("text"), model))
