"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features are the distinct words, pairs of neighbours and skip-grams (pairs with one
word between) of a text, hashed.  Each coordinate has its own learning rate and an
L1 penalty that keeps weights at exactly zero until their evidence passes it, so the
model is a sparse vector that is cheap to broadcast.  The learner passes over the
sample several times in hashed order.  The penalty draws margins towards zero; a logistic
fitted on folds that the model hasn't seen makes them probabilities again.  The sample may hold the
classes in other shares than the labels do; examples are weighted back.

Edge cases: null and empty texts have no features and get the score of the
intercept; ids that are null are scored but never learnt from; null
labels and those of unknown ids are ignored; without two labelled classes every score is
the smoothed share of class 1; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlink.llm import labelled, words

BITS = 20


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = words.tokens(data, offs, words.WORD)
    h, row = words.token_hashes(t), words.text_of_token(t)
    n = len(h)
    rows, out = [row], [labelled.salted(h, 1, BITS)]
    for salt, gap in ((2, 1), (3, 2)):
        if n > gap:
            inside = row[:-gap] == row[gap:]
            pair = words.mix(h[:-gap] * np.uint64(3) + h[gap:])
            rows.append(row[:-gap][inside])
            out.append(labelled.salted(pair[inside], salt, BITS))
    return np.concatenate(rows), np.concatenate(out)


def ftrl(y: np.ndarray, x: list[np.ndarray], weight: np.ndarray, alpha: float, beta: float, l1: float, l2: float,
         epochs: int) -> np.ndarray:
    """Weights by features (each of value 1) and an unpenalised intercept, last."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    z0 = n0 = 0.0
    for _ in range(epochs):
        for f, label, c in zip(x, y, weight):
            zf, nf = z[f], n[f]
            root = np.sqrt(nf)
            w = np.where(np.abs(zf) > l1, -(zf - np.sign(zf) * l1) / ((beta + root) / alpha + l2), 0.0)
            w0 = -z0 / ((beta + n0 ** 0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -50, 50)))
            g = c * (p - label)
            z[f] = zf + g - (np.sqrt(nf + g * g) - root) / alpha * w
            n[f] = nf + g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0 ** 0.5) / alpha * w0
            n0 += g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return np.append(w, -z0 / ((beta + n0 ** 0.5) / alpha))


def learner(prior: float, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0, epochs: int = 6,
            folds: int = 3):
    """Fits (class, features) of a sample; prior: the share of class 1 among all labels."""

    def learn(y: np.ndarray, x: list[np.ndarray]) -> tuple[np.ndarray, float, float]:
        if len(set(y.tolist())) < 2:
            p = min(max((y.sum() + 1) / (len(y) + 2), 1e-6), 1 - 1e-6)
            return np.zeros(1 << BITS), 1.0, float(np.log(p / (1 - p)))
        counts = np.bincount(y, minlength=2)
        weight = np.where(y == 1, prior / counts[1], (1 - prior) / counts[0]) * len(y)

        def model(of: np.ndarray) -> np.ndarray:
            return ftrl(y[of], [x[i] for i in of], weight[of], alpha, beta, l1, l2, epochs)

        part, unseen = np.arange(len(y)) % folds, np.zeros(len(y))
        for k in range(folds):
            w = model(np.flatnonzero(part != k))
            for i in np.flatnonzero(part == k):
                unseen[i] = w[x[i]].sum() + w[-1]
        a, b = labelled.platt(unseen, y, weight)
        w = model(np.arange(len(y)))
        return w[:-1], a, a * w[-1] + b

    return learn


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, **options) -> tuple[np.ndarray, float, float]:
    """The model, from at most ``max_rows`` labelled documents of each class."""
    seen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~labelled.held_out(F.col("doc_id")))
    prior = seen.agg(((F.coalesce(F.sum("toxic"), F.lit(0)) + 1) / (F.count("*") + 2)).alias("p")).first().p
    return labelled.fit(labelled.sample(docs, labels, "toxic", max_rows), features, BITS, learner(prior, **options))


def _sum(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return sums


def scores(docs: DataFrame, model: tuple[np.ndarray, float, float], key: str = "doc_id") -> DataFrame:
    """``k`` (the key column), ``score`` (0 to 1) of every row."""
    return labelled.score(docs, features, BITS, model, _sum, id_col=key)
