import math

import numpy as np
import pytest
from conftest import SF_MID, SF_SMALL
from pyspark.sql import functions as F

from termlink.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<double>"


def dot(v, w):
    """Term by term; ``sum`` would compensate."""
    s = 0.0
    for x, y in zip(v, w):
        s += float(x) * float(y)
    return s


def brute(rows, k=20, step=20):
    """Every query against every row, in double precision."""
    fine = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (i, v) in enumerate(fine):
        if i is not None and i % step == 0:
            scores = []
            for m, (j, w) in enumerate(fine):
                if m != n and len(w) == len(v):
                    scores.append((-dot(v, w), j is not None, j or 0, j))
            for r, (s, _, _, j) in enumerate(sorted(scores)[:k]):
                out.setdefault(i, []).append((r + 1, j, -s))
    return {i: sorted(v, key=lambda x: x[0]) for i, v in out.items()}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {i: sorted(v, key=lambda x: x[0]) for i, v in out.items()}


def recall(got, want):
    return np.mean([len({x[1] for x in got.get(i, [])} & {x[1] for x in v}) / len(v) for i, v in want.items()])


def made(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return neighbours.nearest(df, F.col("vec_id") % 20 == 0, **options)


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_MID])
def test_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = found(queries.op12_nearest_neighbours(spark, sf_dir)), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.99
    vectors = dict(rows)
    for i, v in got.items():
        assert [r for r, _, _ in v] == list(range(1, 21)) and i not in {j for _, j, _ in v}
        assert [(s, j) for _, j, s in v] == [(s, j) for s, j in sorted(((s, j) for _, j, s in v), key=lambda x: (-x[0], x[1]))]
        for _, j, s in v:
            assert s == dot(vectors[i], vectors[j])


def test_a_search_that_has_to_walk(spark):
    """Small lists and beams on 3,000 vectors: most of the way is the graph's."""
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 16)) * r.uniform(0.3, 3, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(made(spark, rows, k=10, near=20, beam=48, visited=8, entries=16, trees=3, leaf=16))
    assert recall(got, {i: v[:10] for i, v in brute(rows).items()}) >= 0.9


def test_hubs_and_copies(spark):
    """A third of the rows are one vector, a third are noisy copies of one, which is nearest to all of them."""
    r = np.random.default_rng(4)
    centre = r.standard_normal(24)
    x = np.concatenate([np.tile(r.standard_normal(24), (400, 1)), centre + 0.1 * r.standard_normal((400, 24)), r.standard_normal((400, 24))])
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(1200), x)] + [(5000, centre.tolist())]
    got, want = found(made(spark, rows, block=16)), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.97
    copies = {i for i, v in rows if v == rows[0][1]}
    for i in copies & got.keys():
        assert [j for _, j, _ in got[i]] == [j for _, j, _ in want[i]]       # ties by id, itself left out


def test_odd_rows(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.standard_normal(5).tolist()) for i in range(15)]
    rows += [(20, None), (40, []), (60, [0.0] * 5), (80, [1.0, None, 0, 0, 0]), (100, [1.0, float("nan"), 0, 0, 0]),
             (120, [float("inf"), 0, 0, 0, 0]), (None, [1.0, 2, 3, 4, 5]), (0, [1.0, 0, 0, 0, 0]), (0, [1.0, 0, 0, 0, 0]),
             (140, [1e200, 0, 0, 0, 1e200]), (160, [1e-200, 0, 0, 1e-200, 0]), (180, [2.0, 1.0]), (181, [-1.0, 1.0]), (200, [1.0])]
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows if i != 0 or v == [1.0, 0, 0, 0, 0]]
    got, want = found(made(spark, rows)), brute(rows)
    assert {i: [(j, s) for _, j, s in v] for i, v in got.items() if i} == {i: [(j, s) for _, j, s in v] for i, v in want.items() if i}
    # both rows with id 0 ask, and are found by each other
    assert len(got[0]) == 2 * 18 and sum(j == 0 for _, j, _ in got[0]) == 2
    wide = spark.createDataFrame([(*x, 1, "clash", 2.0) for x in rows], SCHEMA + ", id int, class string, s double")
    assert found(neighbours.nearest(wide, F.col("vec_id") % 20 == 0)).keys() == got.keys()
    assert made(spark, rows[:0]).count() == 0


def test_codes_are_close():
    r = np.random.default_rng(1)
    for norm in (1e-300, 1e-3, 0.9999999, 1.0, 1.0000001, 1e3, 1e300):
        x = r.standard_normal(32)
        x *= norm / np.sqrt((x * x).sum())
        import pyarrow as pa
        b = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([x.tolist()])], names=["id", "v"])
        _, _, code, scale, rest = (c[0].as_py() for c in next(neighbours._nodes(iter([b]))).columns)
        y = np.frombuffer(code, np.int8) * scale
        assert abs((y * y).sum() + rest ** 2 - 1) < 0.02 and abs(y @ x / np.sqrt((y * y).sum()) / norm - 1) < 1e-3
