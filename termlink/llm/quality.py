"""Quality classifier: naive-Bayes support vectors.

Features are the distinct n-grams of a text, as indicators: words and punctuation
runs, pairs of neighbours, and triples of *shapes* (lower, capitalised or upper-case
word, a word said again, digits, the punctuation itself), which carry over to words
and languages that the labels don't show.  Each indicator is scaled by the log ratio of its smoothed
shares in the two classes; a linear hinge-loss model is fitted to the
scaled vectors (of norm 1 by the square root of their number of features) by dual coordinate
descent, and its margin is turned into a probability by a logistic fitted on
folds that the model hasn't seen, weighted back to the labelled shares.

Edge cases: null and empty texts have no features and get the score of the
intercept; ids that are null are scored but never learnt from; null
labels and those of unknown ids are ignored; without two labelled classes every score
is the smoothed share of class 1; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlink.llm import labelled, words

BITS = 20
_U = np.uint64


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = words.tokens(data, offs, words.SHAPE)
    h, row = words.token_hashes(t), words.text_of_token(t)
    n = len(h)
    if n == 0:
        return row, np.zeros(0, np.int64)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    lower = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
    ups, lows = upper[t.end] - upper[t.start], lower[t.end] - lower[t.start]
    kind = words.SHAPE[data[t.start]]
    shape = np.where((ups > 1) & (lows == 0), 3, np.where(ups > 0, 2, 1)).astype(_U)
    letter = np.flatnonzero(kind == 1)
    again = letter[1:][(h[letter[1:]] == h[letter[:-1]]) & (row[letter[1:]] == row[letter[:-1]])]
    shape[again] = 4
    shape = np.where(kind == 1, shape, np.where(kind == 2, _U(5), h))
    rows, out = [row], [labelled.salted(h, 1, BITS)]
    for salt, of, k in ((2, h, 2), (3, shape, 3)):
        inside = row[: n - k + 1] == row[k - 1:] if n >= k else np.zeros(0, bool)
        rows.append(row[: max(0, n - k + 1)][inside])
        out.append(labelled.salted(words.gram_hashes(of, k)[inside], salt, BITS))
    return np.concatenate(rows), np.concatenate(out)


def descend(x: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int,
            tolerance: float = 1e-3) -> np.ndarray:
    """Weights of the linear hinge-loss model over vectors scale[x] / sqrt(len(x))
    and a constant 1 (last weight), by dual coordinate descent: for one document at a
    time the dual variable is set to its optimum in [0, cost]."""
    w = np.zeros(len(scale) + 1)
    sign = np.where(y == 1, 1.0, -1.0)
    v = [scale[f] / np.sqrt(max(1, len(f))) for f in x]
    q = np.array([u @ u + 1.0 for u in v])
    alpha = np.zeros(len(x))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(x)):
            g = sign[i] * (w[x[i]] @ v[i] + w[-1]) - 1.0
            a = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            d = a - alpha[i]
            if d:
                w[x[i]] += d * sign[i] * v[i]
                w[-1] += d * sign[i]
                alpha[i] = a
                worst = max(worst, abs(d) * q[i])
        if worst < tolerance:
            break
    return w


def learner(prior: float, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 20, folds: int = 4, seed: int = 7):
    """Fits (class, features) of a sample; prior: the share of class 1 among all labels."""

    def ratios(y: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
        share = []
        for c in (1, 0):
            of = [f for f, k in zip(x, y) if k == c]
            n = np.bincount(np.concatenate([*of, np.zeros(0, np.int64)]), minlength=1 << BITS) + smoothing
            share.append(np.log(n / (len(of) + 2 * smoothing)))
        return share[0] - share[1]

    def model(y: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
        r = ratios(y, x)
        each = cost * len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))     # classes weigh the same
        w = descend(x, r, y, each[y], epochs, seed)
        return np.append(w[:-1] * r, w[-1])

    def margins(w: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
        return np.array([w[f].sum() / np.sqrt(max(1, len(f))) for f in x]) + w[-1]

    def learn(y: np.ndarray, x: list[np.ndarray]) -> tuple[np.ndarray, float, float]:
        if len(set(y.tolist())) < 2:
            p = min(max((y.sum() + 1) / (len(y) + 2), 1e-6), 1 - 1e-6)
            return np.zeros(1 << BITS), 1.0, float(np.log(p / (1 - p)))
        part = np.arange(len(y)) % folds
        seen = np.zeros(len(y))
        for k in range(folds):
            train = np.flatnonzero(part != k)
            test = np.flatnonzero(part == k)
            if len(set(y[train].tolist())) == 2:
                seen[test] = margins(model(y[train], [x[i] for i in train]), [x[i] for i in test])
        counts = np.bincount(y, minlength=2)
        weight = np.where(y == 1, prior / counts[1], (1 - prior) / counts[0]) * len(y)
        a, b = labelled.platt(seen, y, weight)
        w = model(y, x)
        return w[:-1], a, a * w[-1] + b

    return learn


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, **options) -> tuple[np.ndarray, float, float]:
    """The model, from at most ``max_rows`` labelled documents of each class."""
    seen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~labelled.held_out(F.col("doc_id")))
    prior = seen.agg(((F.coalesce(F.sum("quality"), F.lit(0)) + 1) / (F.count("*") + 2)).alias("p")).first().p
    return labelled.fit(labelled.sample(docs, labels, "quality", max_rows), features, BITS, learner(prior, **options))


def _mean(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return sums / np.sqrt(np.maximum(1, counts))


def scores(docs: DataFrame, model: tuple[np.ndarray, float, float], key: str = "doc_id") -> DataFrame:
    """``k`` (the key column), ``score`` (0 to 1) of every row."""
    return labelled.score(docs, features, BITS, model, _mean, id_col=key)


def keep_good(docs: DataFrame, labels: DataFrame, reject_below: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``reject_below``, as they are."""
    model = fit(docs, labels, **options)
    whole = docs.select(F.struct(*docs.columns).alias("k"), "text")
    return scores(whole, model, key="k").where(F.col("score") >= reject_below).select("k.*")
