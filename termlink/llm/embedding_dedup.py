"""Links between embeddings of cosine >= a threshold, by collision counting.

The vectors are put on the unit sphere and projected on random directions.  Two
vectors at distance s differ in a projection by a normal number of deviation s,
so close pairs fall in the same query-centred window of most sorted projections and
far pairs of few.

* *Cells.*  Counting all window collisions of all pairs would cost more than
  comparing all pairs (a window that holds a pair of cosine 0.9 nine times in ten holds
  two fifths of all vectors in 64 dimensions).  So ``projections`` sorted projections are cut
  into intervals of ``width`` deviations with a random offset, and their combination is
  a cell; ``tables`` independent sets of projections give as many chances.
* *Counting.*  In a cell, further projections are sorted; around each vector's
  value a window of ``reach`` deviations of a pair at the threshold is taken, and the
  collisions of each pair are counted over them.  Pairs that collide at least ``least``
  times are verified by their cosine in double precision.  ``least`` is calibrated: the
  largest count that a pair at the threshold reaches with the probability asked for
  (a binomial quantile).
* *Tables.*  Their number is calibrated, too: the least that catches a pair at the
  threshold in a common cell.  Cell and count together catch it with probability ``recall``,
  whatever the number of vectors.  Where that takes too many tables (low thresholds), cells are coarser.
  A linked pair counts in the first table that has it in one cell and in no other: the task that links it
  works out the two vectors' cells in the earlier tables, so nothing is shipped or collected to tell repeats apart.

Equal vectors are one representative with a number of copies.  A cell with more
than ``cell_rows`` representatives is dealt to blocks of about this size, and pairs of blocks are tasks: no
task holds a large cell.  Tasks return sums of links by vector and
a spanning forest of their links, never pairs; components come from the forests.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are kept; vectors of different length never link; a null id is
returned and counts as a vector, but isn't the id of a component unless all its
members' are null; rows with equal ids are vectors of their own; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlink.llm.components import components
from termlink.llm.tables import staged


class Plan(NamedTuple):
    """Numbers of cell projections, tables and counted projections, the window's
    half width, the least count."""

    projections: int
    tables: int
    counted: int
    window: float
    least: int


def _normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _same_interval(distance: float, width: float) -> float:
    """The chance that two points whose difference is normal with this deviation fall in
    the same of randomly placed intervals."""
    if distance == 0:
        return 1.0
    t = width / distance
    return 2 * _normal_cdf(t) - 1 - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def calibrate(n: int, threshold: float, sure_at: float | None = None, recall: float = 0.999, width: float = 2.0,
              counted: int = 12, reach: float = 2.0, company: int = 256) -> Plan:
    """The plan for ``n`` vectors: cells fine enough that a vector has about ``company`` others in
    its cell by chance, and as many tables as the recall of pairs of cosine ``sure_at`` (the threshold,
    unless given) asks for.  Cells are coarser if their tables cost less, where a vector in a table costs as
    much as ``company`` comparisons besides those in its cell."""
    # a pair has to pass the cells and the count
    each = math.sqrt(recall)
    far = _same_interval(math.sqrt(2), width)
    near = _same_interval(math.sqrt(2 - 2 * (threshold if sure_at is None else sure_at)), width)

    def tables(k: int) -> int:
        return 1 if near ** k >= each else math.ceil(math.log(1 - each) / math.log1p(-near ** k))

    finest = max(2, math.ceil(math.log(max(2.0, n / company)) / -math.log(far)))
    k = min(range(1, finest + 1), key=lambda k: tables(k) * (n * far ** k + company))
    edge = math.sqrt(2 - 2 * threshold)
    hit = 2 * _normal_cdf(reach) - 1
    least, tail = counted, 0.0
    while least > 0:
        tail += math.comb(counted, least) * hit ** least * (1 - hit) ** (counted - least)
        if tail >= each:
            break
        least -= 1
    return Plan(k, tables(k), counted, reach * edge, least)


def _directions(seed: int, dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _cell_links(x: np.ndarray, y: np.ndarray, plan: Plan, aim: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked pairs between two blocks of a cell."""
    px, py = x @ aim, y @ aim
    count = np.zeros((len(x), len(y)), dtype=np.uint8)
    for j in range(plan.counted):
        order = np.argsort(py[:, j], kind="stable")
        values = py[order, j]
        low = np.searchsorted(values, px[:, j] - plan.window, "left")
        high = np.searchsorted(values, px[:, j] + plan.window, "right")
        # in sorted order a window is a run: mark its ends and sum up
        runs = np.zeros((len(x), len(y) + 1), dtype=np.int8)
        each = np.arange(len(x))
        np.add.at(runs, (each, low), 1)
        np.add.at(runs, (each, high), -1)
        count[:, order] += np.cumsum(runs[:, :-1], axis=1, dtype=np.int8).view(np.uint8)
    i, j = np.nonzero(count >= plan.least)
    keep = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), 1 << 14):
        s = slice(a, a + (1 << 14))
        keep[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= threshold
    return i[keep], j[keep]


@lru_cache(maxsize=4)
def _grid(seed: int, dim: int, cells: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells' directions, in whole numbers, and offsets."""
    return np.rint(_directions(seed, dim, cells) * 2.0 ** 20), np.random.default_rng([seed, 0]).random(cells) * width


def _cells_of(x: np.ndarray, plan: Plan, width: float, seed: int) -> np.ndarray:
    """The cell of each vector (rows of norm 1) in each table.  The projections are sums of whole numbers that
    are exact in double precision, so that every task finds the same."""
    aims, shift = _grid(seed, x.shape[1], plan.projections * plan.tables, width)
    whole = np.rint(x * 2.0 ** 20) @ aims
    at = np.floor((whole * 2.0 ** -40 + shift) / width).astype(np.int64)
    return _folded(at.reshape(-1, plan.projections), x.shape[1]).reshape(len(x), plan.tables)


def _met_before(v: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, plan: Plan, width: float, seed: int) -> np.ndarray:
    """Whether the vectors i and j share a cell of an earlier table."""
    out = np.zeros(len(i), dtype=bool)
    if table and len(i):
        some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = np.concatenate([_cells_of(v[some[a: a + 1024]], plan, width, seed)[:, :table] for a in range(0, len(some), 1024)])
        at_i, at_j = at[: len(i)], at[len(i):]
        for a in range(0, len(i), 1 << 14):
            s = slice(a, a + (1 << 14))
            out[s] = (keys[at_i[s]] == keys[at_j[s]]).any(axis=1)
    return out


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of pairs of numbers."""
    up: dict[int, int] = {}

    def top(a: int) -> int:
        while up.setdefault(a, a) != a:
            up[a] = a = up[up[a]]
        return a

    out = []
    for a, b in pairs.tolist():
        ra, rb = top(a), top(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def representatives(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, classes)``: rows ``row, vec_id, class`` of all vectors, class null if it can't link;
    classes ``class, v, copies, low`` (smallest id) of distinct vectors."""
    wide = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value here
    rows = staged(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"),
                                 F.when(fine, F.transform(v, lambda x: x + F.lit(0.0))).cast(wide).alias("v")), "vectors")
    classes = staged(rows.where("v is not null").groupBy("v").agg(
        F.min("row").alias("class"), F.count("*").alias("copies"), F.min("vec_id").alias("low")), "vector-classes")
    member = rows.join(classes.select("v", "class"), "v", "left").select("row", "vec_id", "class")
    return member, classes


def links(classes: DataFrame, threshold: float, plan: Plan, cell_rows: int = 1024, width: float = 2.0,
          seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(sums, edges)``: sums ``class, n`` of the copies of linked vectors (partial, by task); edges
    ``a, b`` with the components of all links."""
    dtype = "<f4" if classes.schema["v"].dataType.simpleString() == "array<float>" else "<f8"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, out = [], []
            for v in b.column(1):
                x = v.values.to_numpy(zero_copy_only=False).astype(dtype)
                raw.append(x.tobytes())
                out.append(_cells_of(_unit(x[None, :]), plan, width, seed)[0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(raw, pa.binary()), b.column(2), pa.array(out, pa.list_(pa.int32()))], names=["class", "v", "copies", "cells"])

    keyed = staged(classes.select("class", "v", "copies").mapInArrow(
        keys, "class long, v binary, copies long, cells array<int>"), "vector-keys")
    listed = keyed.select("class", F.posexplode("cells").alias("table", "cell"))
    sizes = listed.groupBy("table", "cell").count().where("count > 1")
    blocks = F.ceil(F.col("count") / cell_rows)
    listed = (listed.join(sizes, ["table", "cell"])
              .withColumn("blocks", blocks.cast("int"))
              .withColumn("mine", F.pmod(F.xxhash64(F.lit(seed), "class"), F.col("blocks")).cast("int"))
              # a block meets itself, and each other block once
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("class", "table", "cell", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")))
    dealt = listed.join(keyed.drop("cells"), "class").repartition(F.col("table"), F.col("cell"), F.col("x"), F.col("y")).sortWithinPartitions(
        "table", "cell", "x", "y", "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (table, _, left, right), part in _groups(batches):
            found: list[tuple[np.ndarray, np.ndarray]] = []
            dims = np.array([len(v) for v in part["v"]])
            for size in np.unique(dims).tolist():
                own = np.flatnonzero(dims == size)
                v = _unit(np.frombuffer(b"".join([part["v"][i] for i in own.tolist()]), dtype).reshape(len(own), -1))
                dim = v.shape[1]
                mine = part["mine"][own]
                a, b = np.flatnonzero(mine == left), np.flatnonzero(mine == right)
                aim = _aims(seed + 1, dim, plan.counted)
                for s in range(0, len(a), 512):
                    # a part of the block at a time: the counts of 512 by cell_rows pairs
                    rows = a[s: s + 512]
                    i, j = _cell_links(v[rows], v[b], plan, aim, threshold)
                    i, j = rows[i], b[j]
                    if left == right:
                        i, j = i[i < j], j[i < j]
                    new = ~_met_before(v, i, j, table, plan, width, seed)
                    found.append((own[i[new]], own[j[new]]))
            i = np.concatenate([f[0] for f in found])
            j = np.concatenate([f[1] for f in found])
            if not len(i):
                continue
            ids, copies = part["class"], part["copies"]
            n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            hit = np.flatnonzero(n)
            tree = _forest(np.stack([ids[i], ids[j]], axis=1))
            rows = len(hit) + len(tree)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ids[hit], np.array([t[0] for t in tree], np.int64)])),
                pa.array([None] * len(hit) + [t[1] for t in tree], pa.int64()),
                pa.array(np.concatenate([n[hit].astype(np.int64), np.zeros(rows - len(hit), np.int64)]))], names=["a", "b", "n"])

    out = staged(dealt.select("table", "cell", "x", "y", "mine", "class", "v", "copies")
                 .mapInArrow(compare, "a long, b long, n long"), "vector-links")
    return out.where("b is null").select(F.col("a").alias("class"), "n"), out.where("b is not null").select("a", "b")


_aim_cache: dict[tuple[int, int, int], np.ndarray] = {}


def _aims(seed: int, dim: int, n: int) -> np.ndarray:
    if (seed, dim, n) not in _aim_cache:
        _aim_cache.clear() if len(_aim_cache) > 16 else None
        _aim_cache[seed, dim, n] = _directions(seed, dim, n)
    return _aim_cache[seed, dim, n]


def _folded(at: np.ndarray, dim: int) -> np.ndarray:
    """One number for each row of intervals.  Should two cells meet in a number, their
    vectors are compared in vain."""
    h = np.full(len(at), dim, dtype=np.uint64)
    for j in range(at.shape[1]):
        h = (h ^ at[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to norm 1 in double precision, without overflow on the way."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int, int], dict]]:
    """Successive rows with equal (table, cell, x, y)."""
    key, held = None, []

    def part() -> dict:
        t = pa.Table.from_batches(held)
        return {"class": t["class"].to_numpy(), "copies": t["copies"].to_numpy(), "mine": t["mine"].to_numpy(),
                "v": t["v"].to_pylist()}

    for b in batches:
        k = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            now = tuple(k[lo].tolist())
            if now != key and held:
                yield key, part()
                held = []
            key = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, part()


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
                    width: float = 2.0, cell_rows: int = 1024, seed: int = 42, **calibration) -> DataFrame:
    """One row ``vec_id, n_links, component_id, kept`` per row of ``vectors``."""
    rows, classes = representatives(vectors, id_col, vector_col)
    plan = calibrate(classes.count(), threshold, width=width, **calibration)
    sums, edges = links(classes, threshold, plan, cell_rows, width, seed)
    found = components(edges)
    n = sums.groupBy("class").agg(F.sum("n").alias("n"))
    c = (classes.select("class", "copies", "low").join(n, "class", "left")
         .join(found.withColumnRenamed("node", "class"), "class", "left")
         .select("class", "low", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                 F.coalesce("root", "class").alias("root")))
    ids = c.groupBy("root").agg(F.min("low").alias("component_id"))
    known = c.join(ids, "root").select("class", "n_links", "component_id")
    return rows.join(known, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
