import numpy as np
import pytest

from termlink.llm import embedding_dedup as E


def plain(rows, threshold):
    """All cosines, in double precision."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(rows)
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a < b and len(x) == len(y):
                if x / np.abs(x).max() @ (y / np.abs(y).max()) / np.linalg.norm(x / np.abs(x).max()) / np.linalg.norm(y / np.abs(y).max()) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    up[top(a)] = top(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, n[i], least.get(top(i)), d == least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df, **options):
    return sorted(map(tuple, E.near_duplicates(df, **options).collect()), key=str)


def clusters(rng, dim, groups, size, noise):
    out = []
    for _ in range(groups):
        c = rng.standard_normal(dim)
        out += [(c + noise * rng.standard_normal(dim)).tolist() for _ in range(size)]
    return out


@pytest.mark.parametrize("dim, noise, kind", [(64, 0.1, "float"), (64, 0.28, "double"), (8, 0.2, "double")])
def test_against_all_pairs(spark, dim, noise, kind):
    rng = np.random.default_rng(dim)
    vs = clusters(rng, dim, 25, 12, noise)
    vs += vs[:30] + [rng.standard_normal(dim).tolist() for _ in range(100)]
    if kind == "float":
        vs = [np.array(v, np.float32).astype(float).tolist() for v in vs]
    rows = [(i, v) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
    want, have = plain(rows, 0.9), got(df)
    links, found = sum(r[1] for r in want), sum(r[1] for r in have)
    assert all(h[1] <= w[1] for h, w in zip(sorted(have), sorted(want)))
    assert found >= 0.999 * links > 0
    if noise < 0.15:
        assert have == want


def test_large_cells_are_dealt_to_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(clusters(rng, 16, 2, 90, 0.02))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert got(df, cell_rows=16) == got(df) == plain(rows, 0.9)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.1]), (10, [-1.0, 0.0]),
            (11, [1.0, 0.0, 0.0]), (12, [1e300, 1e300]), (13, [1e-300, 1e-300]), (14, [-0.0, 5.0]), (15, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'clash' as class", "1 as n").repartition(3)
    want = [(d, n, c if d is None or n else d, k) for d, n, c, k in plain(rows, 0.9)]
    assert got(df) == sorted(want, key=str)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_calibration_matches_simulation():
    rng = np.random.default_rng(0)
    for distance, width in ((0.447, 2.0), (1.414, 2.0), (0.3, 1.0)):
        x, shift = rng.standard_normal(200_000) * 5, rng.random(200_000) * width
        y = x + distance * rng.standard_normal(200_000)
        same = np.mean(np.floor((x + shift) / width) == np.floor((y + shift) / width))
        assert E._same_interval(distance, width) == pytest.approx(same, abs=0.005)
    plan = E.calibrate(50_000, 0.9)
    near = E._same_interval((2 - 1.8) ** 0.5, 2.0) ** plan.projections
    assert 1 - (1 - near) ** plan.tables >= 0.9
    hits = np.abs(rng.standard_normal((100_000, plan.counted)) * 0.2 ** 0.5) <= plan.window
    assert np.mean(hits.sum(axis=1) >= plan.least) >= 0.998


@pytest.mark.parametrize("cosine", [0.9, 0.92])
def test_recall_at_the_threshold_is_the_same_at_every_size(cosine):
    dim, width, seed = 64, 2.0, 42
    rng = np.random.default_rng(1)
    x, y = (E._unit(rng.standard_normal((5_000, dim))) for _ in range(2))
    y = E._unit(y - (x * y).sum(axis=1)[:, None] * x)
    y = cosine * x + (1 - cosine ** 2) ** 0.5 * y
    for n in (1_000, 100_000, 10_000_000, 1_000_000_000):
        plan = E.calibrate(n, 0.9)
        cells = plan.projections * plan.tables
        shift = np.random.default_rng([seed, 0]).random(cells) * width
        a, b = (np.floor((v @ E._aims(seed, dim, cells) + shift) / width).reshape(len(v), plan.tables, -1) for v in (x, y))
        aim = E._aims(seed + 1, dim, plan.counted)
        met = (a == b).all(axis=2).any(axis=1)
        counted = (np.abs(x @ aim - y @ aim) <= plan.window).sum(axis=1) >= plan.least
        assert np.mean(met & counted) >= 0.996, (n, plan)


def test_calibration_at_the_ends():
    assert E.calibrate(1_000_000, 1.0).tables == 1
    low = E.calibrate(1_000_000, 0.5)
    assert low.projections < E.calibrate(1_000_000, 0.9).projections


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0]), ("d", None)], "vec_id string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    assert got == {"a": (1, "a", True), "b": (1, "a", False), "c": (0, "c", True), "d": (0, "d", True)}
