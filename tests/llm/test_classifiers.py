import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_MID
from pyspark.sql import functions as F

from termlink.llm import labelled, quality, queries, toxicity, words as W


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.mark.parametrize("query, label, right, caught", [
    (queries.op6_quality_classifier, "quality", 0.97, 0.97), (queries.op7_toxicity, "toxic", 0.9, 0.6)])
def test_held_out_rows(spark, query, label, right, caught):
    rows = query(spark, SF_MID).collect()
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == is_held_out(r.doc_id) for r in rows)
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) >= right
    assert np.mean([r.predicted for r in held if known[r.doc_id] == 1]) >= caught
    good = [r.score for r in held if known[r.doc_id] == 1]
    bad = [r.score for r in held if known[r.doc_id] == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.85


def test_scores_do_not_depend_on_held_out_labels_or_other_columns(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.fit(docs, labels)
    b = quality.fit(docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")}).repartition(7), flipped)
    assert np.array_equal(a[0], b[0]) and a[1:] == b[1:]


def brute_features(text, gaps):
    """Distinct words, and pairs at the given distances."""
    w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    return {(x,) for x in w} | {(g, a, b) for g in gaps for a, b in zip(w, w[g:])}


def test_features_of_a_text():
    texts = ["one two one three", "", "x", "one two one three", "two  ONE"]
    data = pa.array(texts)
    (i, j, raw, offs), = W.slices(data)
    row, f = labelled.distinct(*toxicity.features(raw, offs), toxicity.BITS)
    assert [int((row == t).sum()) for t in range(5)] == [len(brute_features(t, (1, 2))) for t in texts]
    assert np.array_equal(f[row == 0], f[row == 3])


def test_dual_coordinate_descent_reaches_the_optimum():
    """The duality gap closes on a small problem."""
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 12, 4)) for _ in range(60)]
    y = np.array([int((3 in f) or (rng.random() < 0.1)) for f in x])
    scale, cost = rng.standard_normal(12), np.full(60, 0.7)
    w = quality.descend(x, scale, y, cost, 3000, 0, 1e-9)
    m = np.zeros((60, 13))
    for i, f in enumerate(x):
        m[i, f] = scale[f] / np.sqrt(len(f))
        m[i, 12] = 1
    s = np.where(y == 1, 1, -1)

    def primal(v):
        return 0.5 * v @ v + np.sum(cost * np.maximum(0, 1 - s * (m @ v)))

    best = primal(w)
    for _ in range(300):
        assert primal(w + 0.05 * rng.standard_normal(13)) >= best - 1e-6


def test_ftrl_is_sparse_and_finds_the_word():
    rng = np.random.default_rng(2)
    x = [np.unique(np.append(rng.integers(10, 5000, 30), [1] if i % 5 == 0 else [2])) for i in range(400)]
    y = np.array([int(i % 5 == 0) for i in range(400)])
    w = toxicity.ftrl(y, x, np.ones(400), 1.0, 1.0, 8.0, 0.0, 6)
    assert w[1] > 0 and (w[:-1] != 0).sum() < 20
    assert all((w[f].sum() + w[-1] > -0.5) == bool(k) for f, k in zip(x, y))


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, label):
    docs = [(i, ("good fine text " if i % 2 else "bad %%% stuff &&& ") * 5, "clash") for i in range(60)]
    docs += [(100, None, "c"), (101, "", "c"), (None, "no id", "c"), (1, "again", "c"), (1, "again", "c"), (102, "w " * 60_000, "c")]
    labels = [(i, i % 2, i % 2) for i in range(60)] + [(3, 0, 0), (None, 1, 1), (5, None, None), (9999, 1, 1), (7, 1, 1), (7, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = module.fit(d, lab)
    got = module.scores(d, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {r.k: r.score for r in got}
    assert by[100] == by[101] and by[9] > by[10]
    assert module.scores(d.limit(0), model).count() == 0
    for few in (lab.limit(0), lab.where(F.col(label) == 1), lab.select("doc_id", F.lit(None).cast("int").alias(label))):
        s = {r.score for r in module.scores(d, module.fit(d, few)).collect()}
        assert len(s) == 1 and 0 < s.pop() < 1


def test_sample_is_bounded_and_balanced(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text")
    labels = spark.range(500).selectExpr("id as doc_id", "cast(id % 5 = 0 as int) as quality")
    got = labelled.sample(docs, labels, "quality", 40).collect()
    assert sum(r.y for r in got) == 40 and len(got) == 80
    assert not any(is_held_out(r.doc_id) for r in got)


def test_keep_good_returns_rows_as_they_are(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema or kept.columns == docs.columns
    want = {r.doc_id for r in queries.op6_quality_classifier(spark, SF_MID).where("predicted = 1").collect()}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == want
    whole = {r.doc_id: r for r in docs.collect()}
    assert all(tuple(r) == tuple(whole[r.doc_id]) for r in rows)
