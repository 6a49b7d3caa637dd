"""What the two text classifiers share: the labelled sample, hashed feature
vectors, fitting in one task, scoring in all.

A classifier is fitted on a bounded sample of labelled rows: per class at most
``max_rows`` documents, those with the least hashes of their ids.  The sample's ids
are a table of that size, so they are broadcast to the documents; only the
sample's texts are shuffled.  The fitted weights are one vector of ``2**bits``
numbers, broadcast for scoring; scoring reads every text whole and once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlink.llm import words
from termlink.llm.tables import small_text_batches

#: (bytes, offsets) of a slice of texts -> (text number, feature) of each feature;
#: repeats allowed.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: (class 0 or 1, distinct features) of each sampled document -> (weights, scale, shift)
Fit = Callable[[np.ndarray, list[np.ndarray]], tuple[np.ndarray, float, float]]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def salted(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Feature numbers below 2**bits of hashes, by kind of feature."""
    return (words.mix(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


def distinct(rows: np.ndarray, features: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (text number, feature) once, in order."""
    key = np.unique((rows.astype(np.int64) << bits) | features)
    return key >> bits, key & ((1 << bits) - 1)


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``y, text`` of at most ``max_rows`` labelled documents of each class that are
    not held out.  Ids with contradicting labels are left out; of documents
    with the same id the least text counts."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top").drop("top"))
    parts = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for c in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    return (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")    # at most 2 * max_rows ids
            .groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.coalesce("text", F.lit(""))).alias("text")))


def fit(rows: DataFrame, features: Features, bits: int, learn: Fit) -> tuple[np.ndarray, float, float]:
    """``learn`` applied to the distinct features of ``rows`` (doc_id, y, text), in the order
    of hashed ids, in one task."""
    small_text_batches(rows.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in words.slices(b.column(2)):
                row, f = distinct(*features(data, offs), bits)
                f = f.astype("<u4")
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i),
                     pa.array([f[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())], names=["o", "y", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
        got.sort(key=lambda x: x[0])
        y = np.array([x[1] for x in got], dtype=np.int64)
        w, scale, shift = learn(y, [np.frombuffer(x[2], "<u4").astype(np.int64) for x in got])
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([float(scale)]),
                                          pa.array([float(shift)])], names=["w", "scale", "shift"])

    model = (rows.select(F.xxhash64(F.lit(1), "doc_id").alias("o"), F.col("y").cast("int").alias("y"), "text")
             .mapInArrow(extract, "o long, y int, f binary").repartition(1)
             .mapInArrow(train, "w binary, scale double, shift double")).first()
    return np.frombuffer(model.w, "<f4"), model.scale, model.shift


def score(docs: DataFrame, features: Features, bits: int, model: tuple[np.ndarray, float, float],
          reduce: Callable[[np.ndarray, np.ndarray], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k, score`` for each row: the logistic of scale * margin + shift.  k is the id
    column, or a struct of columns.  reduce: (sums of weights, numbers of features) of
    texts -> margins."""
    spark = docs.sparkSession
    small_text_batches(spark)
    w, scale, shift = model
    weights = spark.sparkContext.broadcast(w)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = weights.value.astype(np.float64)
        for b in batches:
            out = []
            for i, j, data, offs in words.slices(b.column(1)):
                row, f = distinct(*features(data, offs), bits)
                margin = reduce(np.bincount(row, v[f], j - i), np.bincount(row, minlength=j - i))
                out.append(1 / (1 + np.exp(-np.clip(scale * margin + shift, -500, 500))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))],
                                             names=["k", "score"])

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).mapInArrow(run, f"k {kind}, score double")


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift of a logistic in one variable, by damped Newton steps, with
    targets drawn in as Platt did, so that separable samples stay finite."""
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-12
        m = np.array([[np.sum(h * margin * margin), np.sum(h * margin)], [np.sum(h * margin), np.sum(h)]]) + 1e-6 * np.eye(2)
        d = np.linalg.solve(m, np.array([np.sum(g * margin), np.sum(g)]))
        d *= min(1.0, 5 / max(1e-12, np.abs(d).max()))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(b)
