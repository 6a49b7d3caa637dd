"""Record linkage joins: exact, residual (anti) and Jaro-Winkler fuzzy.

Output shape follows the matching library the reference used: the two
unique keys, then every other column of each side; a column present on both
sides gets the side's suffix (``trait_rare`` / ``trait_common``).

Fuzzy join plan. A pair of distance ``d <= maxDist`` with ``l`` common first
characters (4 at most) has a Jaro of at least ``J(l) = 1 - maxDist/(1 - p l)``.

1. distinct non-null strings per side — duplicates are scored once; equal
   strings are matched by an equi-join and go no further;
2. two families of cells, each pair in one: pairs that share their first two
   characters meet by these and a length band, under ``J(4)``; all others
   share one character at most and meet by length band alone, under the tighter
   ``J(1)``. Bands are a fraction of what the length bound allows; right
   strings are listed in every band that holds lengths they can match;
3. a cell larger than ``block_rows`` (or ``_BLOCK_CHARS``) on a side is dealt to blocks, and pairs of
   blocks are the units of work, so no task holds a large cell; units are worked off in rounds where their copies would fill the disk;
4. inside a unit strings are sorted by a further contrast, and a matrix product bounds the pairs
   within its reach by grouped character counts; the pairs left are bounded by all their character
   counts. What is left is scored from each left string's most promising pair on, as long as the bound
   can reach its best (``jw_scored`` without settings scores all, after a bound by how many of the left
   string's pairs of characters are found in place, below);
5. best right row per left string = ``min(struct(d, right_key))`` — a hash
   aggregate with partial combine, so no group is sorted in one task;
6. join back to the left rows and the chosen right row.

Bounds for Jaro >= J, with ``m`` matches and ``t`` transpositions:

* ``m >= m0 = (3J-1)|a||b|/(|a|+|b|)`` and ``min(|a|,|b|) >= (3J-2) max(|a|,|b|)``;
* ``m`` is at most the common characters ``c``, counted with repeats (any grouping of
  characters bounds it, too);
* so the L1 distance of their character counts, a metric, is ``T = |a|+|b|-2 m0`` at most. A contrast, the
  number of characters of one set less that of another one, differs by no more than that distance: neither do
  two strings' contrasts differ by more than ``T``. Any sets keep all pairs; those taken vary most in a sample;
* cut ``a`` into pairs of neighbours. A pair isn't found in ``b`` as neighbours
  within ``max(|a|,|b|) - m0`` places only if it holds an unmatched character of
  ``a``, or a matched one out of order, or is parted by an unmatched character of
  ``b``: ``|a|+|b|-2m+2t`` times at most (one more if ``t`` is rounded down). With
  ``2t <= 2m (m/|a|+m/|b|+1-3J)`` this is convex in ``m``, so it is largest at
  ``m0`` or at ``c``.
"""

from __future__ import annotations

import gc
import math
import sys
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlink.functions.jaro import ROUND_DIGITS, code_points, jaro_parts, padded_codes, small_codes
from termlink.operators.rows import dedupe_first
from termlink.session import staging_path
from termlink.sources.files import stage_parquet

_EPS = 1e-9
_GRID = 2048               # rows a side of a value that are joined in one place
_COPIES = 64                # blocks a side of a value at most: a row is shuffled that many times, however many pairs it has
_RINGS = 2                  # contrasts by which strings are dealt; a further one sorts them inside a unit
_SAMPLE = 2048              # strings that the contrasts are chosen by
_ALPHABET = 256
_FINE = 64                  # character groups
_STEPS = 128                # "at least t characters of a group" that the first bound takes one by one
_DEEP = 256                 # t at most
_STRIP = 128                # left strings that are bounded together
_BLOCK = 16384              # strings a side of a unit at most, about
_BLOCK_CHARS = 1_000_000    # and characters, as long strings cost more to score
_TASK_PAIRS, _TASKS = 100_000_000, 4096     # pairs of a unit's strings that a task is meant to have; tasks at most
_ROW_BYTES = 40             # of a string's copy besides its characters, about
_ROUND, _ROUND_X = 2 << 30, 1.25    # bytes of copies in a round: so many, or so many times the strings
_PENDING = 50_000           # pairs that are scored together
_CHARS = 2_000_000          # characters of such pairs, at most (a longer pair alone)
_HELD = 8                   # times as many are held to find a left string's best ones
_TIE = 2e-9                 # distances closer than this may be equal when rounded

# the cell scorer runs in Python workers: ship this module by value
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover
    pass


# ---------------------------------------------------------------------------
# shared helpers
# ---------------------------------------------------------------------------

def suffixed(df: DataFrame, other: DataFrame, key: str, suffix: str) -> DataFrame:
    """Rename columns that also exist on the other side (except keys)."""
    common = set(df.columns) & set(other.columns)
    return df.select([F.col(c).alias(f"{c}{suffix}" if c in common and c != key else c)
                      for c in df.columns])


def attach_sides(best: DataFrame, left: DataFrame, right: DataFrame, left_key: str,
                 right_key: str, suffixes: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """``best`` holds (left_key, right_key, *extra); add both sides' columns."""
    ls = suffixed(left, right, left_key, suffixes[0])
    rs = suffixed(right, left, right_key, suffixes[1])
    out = best.join(ls, left_key).join(rs, right_key)
    return out.select(*ls.columns, *[c for c in rs.columns], *extra)


def best_per_left(pairs: DataFrame, left: DataFrame, right: DataFrame, by_left: str,
                  by_right: str, left_key: str, right_key: str) -> DataFrame:
    """From scored string pairs (``sl``, ``sr``, ``d``) pick, per left row, the
    right row with the smallest (d, right key).

    The right key chosen for a right string is its smallest key, found by a
    partial aggregate; the best per left string is another aggregate. The
    result is joined back to the left rows by string.
    """
    rmin = (right.where(F.col(by_right).isNotNull())
            .groupBy(F.col(by_right).alias("sr"))
            .agg(F.min(right_key).alias("__rk")))
    best = (pairs.join(rmin, "sr")
            .groupBy("sl")
            .agg(F.min(F.struct(F.col("d"), F.col("__rk"))).alias("__b")))
    rows = left.select(F.col(left_key), F.col(by_left).alias("sl")).where(F.col("sl").isNotNull())
    return rows.join(best, "sl").select(F.col(left_key), F.col("__b.__rk").alias(right_key),
                                        F.col("__b.d").alias("dist"))


# ---------------------------------------------------------------------------
# exact
# ---------------------------------------------------------------------------

def link_exact(left: DataFrame, right: DataFrame, by: str, left_key: str, right_key: str,
               suffixes: Sequence[str] = ("_1", "_2")) -> DataFrame:
    """Inner equi-join on ``by``; all pairs; nulls never match.

    A value of many rows on both sides is small in bytes but makes a product of
    pairs, which AQE's skew split (by bytes) doesn't see: its rows are dealt to a
    grid of ``_GRID`` by ``_GRID`` rows a cell, each side copied along the other's blocks
    (larger cells from ``_COPIES`` blocks a side on, so what is shuffled grows with the rows).
    """
    ls = suffixed(left, right, left_key, suffixes[0])
    rs = suffixed(right, left, right_key, suffixes[1])
    lb = by + suffixes[0] if by in right.columns else by
    rb = by + suffixes[1] if by in left.columns else by

    def counted(df: DataFrame, c: str, n: str) -> DataFrame:
        return df.where(F.col(c).isNotNull()).groupBy(F.xxhash64(c).alias("__h")).agg(F.count(F.lit(1)).alias(n))

    # (number of pairs / _GRID ** 2) rows at most
    heavy = F.broadcast(counted(ls, lb, "__nl").join(counted(rs, rb, "__nr"), "__h")
                        .where(F.col("__nl").cast("double") * F.col("__nr") > F.lit(float(_GRID * _GRID)))
                        .select("__h", *[F.least(F.ceil(F.col(n) / _GRID), F.lit(_COPIES)).cast("int").alias(b) for n, b in (("__nl", "__bl"), ("__nr", "__br"))]))

    def dealt(df: DataFrame, c: str, key: str, own: str, other: str) -> DataFrame:
        blocks = [F.coalesce(F.col(x), F.lit(1)) for x in (own, other)]
        return (df.where(F.col(c).isNotNull()).withColumn("__h", F.xxhash64(c)).join(heavy, "__h", "left")
                .select(*df.columns, F.pmod(F.xxhash64(key), blocks[0]).cast("int").alias(f"{own}_at"),
                        F.explode(F.sequence(F.lit(0), blocks[1] - 1)).alias(f"{other}_at")))

    x = dealt(ls, lb, left_key, "__bl", "__br")
    y = dealt(rs, rb, right_key, "__br", "__bl")
    same = (F.col(f"x.{lb}") == F.col(f"y.{rb}")) & (F.col("x.__bl_at") == F.col("y.__bl_at")) & (F.col("x.__br_at") == F.col("y.__br_at"))
    return (x.alias("x").join(y.alias("y"), same, "inner")
            .select(*[F.col(f"x.{c}") for c in ls.columns], *[F.col(f"y.{c}") for c in rs.columns]))


def exact_matched(left: DataFrame, right: DataFrame, by: str, left_key: str, right_key: str,
                  suffixes: Sequence[str] = ("_1", "_2")) -> DataFrame:
    """The left rows that :func:`link_exact` links, each with the smallest right key of its value
    instead of all: a row for each, however many pairs there are. Enough wherever only the matched keys count."""
    return link_exact(left, dedupe_first(right, by, right_key), by, left_key, right_key, suffixes)


def exact_members(left: DataFrame, right: DataFrame, by: str, name: str = "class") -> tuple[DataFrame, DataFrame]:
    """What :func:`link_exact` links on the text ``by``, as members of classes: each side's rows whose text
    is on both sides, with the text's digest as ``name``. Rows of one class are its pairs, so
    ``link_exact`` on ``name`` gives them all; the members are no more than the rows, however many pairs there are."""
    def members(df: DataFrame, other: DataFrame) -> DataFrame:
        texts = other.select(by).where(F.col(by).isNotNull()).distinct()
        return df.join(texts, by, "left_semi").select(*df.columns, F.sha2(F.col(by), 256).alias(name))

    return members(left, right), members(right, left)


def residual_anti(df: DataFrame, matched: DataFrame, key: str, matched_key: str | None = None) -> DataFrame:
    """Rows whose key was not matched (``! key %in% matched``; nulls kept)."""
    m = matched.select(F.col(matched_key or key).alias("__m")).where(F.col("__m").isNotNull())
    return df.join(m, F.col(key) == F.col("__m"), "left_anti")


# ---------------------------------------------------------------------------
# Jaro-Winkler
# ---------------------------------------------------------------------------

def jw_bounds(p: float, max_dist: float) -> tuple[float, float]:
    """The least Jaro of a pair with 4 common first characters and with 1."""
    if not 0.0 <= p < 0.25:
        raise ValueError("prefix weight p must lie in [0, 0.25)")
    loose, tight = 1.0 - max_dist / (1.0 - 4.0 * p), 1.0 - max_dist / (1.0 - p)
    if 3.0 * loose - 2.0 <= 0.0:
        raise ValueError("maxDist too loose for lossless pruning (needs 3j - 2 > 0)")
    return loose, tight


def _pieces_found(a: list[str], b: list[str], reach: int) -> np.ndarray:
    """How many of a's pairs of neighbours (places 0-1, 2-3, ...) stand in b
    within ``reach`` places, per pair of strings."""
    A, B, la, lb = padded_codes(a, b)
    wide = A.shape[1] // 2
    if wide == 0 or B.shape[1] < 2:
        return np.zeros(len(a), dtype=np.int64)
    x = A[:, 0:2 * wide:2].astype(np.uint32) << 16 | A[:, 1:2 * wide:2]
    y = np.zeros((len(a), 2 * wide + 2 * reach), dtype=np.uint32)    # 0 is in no piece
    own = (B[:, :-1].astype(np.uint32) << 16 | B[:, 1:])[:, :2 * wide + reach]
    y[:, reach:reach + own.shape[1]] = own
    found = np.zeros(x.shape, dtype=bool)
    for shift in range(2 * reach + 1):
        found |= x == y[:, shift:shift + 2 * wide:2]
    return (found & (np.arange(wide)[None, :] < (la // 2)[:, None])).sum(axis=1)


def _score(a: list[str], b: list[str], p: float, max_dist: float, half: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, jaro, prefix) of the aligned pairs that can be within ``max_dist``."""
    flat, lens = code_points([*a, *b])
    codes, alphabet = small_codes(flat)
    width = min(alphabet, 512)      # further characters share columns, which only raises the overlap
    n = len(a)
    counts = np.bincount(np.repeat(np.arange(2 * n), lens) * width + codes % max(width, 1),
                         minlength=2 * n * width).reshape(2 * n, width)
    c = np.minimum(counts[:n], counts[n:]).sum(axis=1)
    la, lb = lens[:n].astype(np.float64), lens[n:].astype(np.float64)
    pref = np.zeros(n, dtype=np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        while pref[i] < 4 and pref[i] < len(x) and x[pref[i]:pref[i] + 1] == y[pref[i]:pref[i] + 1]:
            pref[i] += 1
    least = 1.0 - max_dist / (1.0 - p * pref)
    keep = np.flatnonzero((c / la + c / lb + 1.0) / 3.0 >= least - _EPS)
    if alphabet < 1 << 16:
        a0, b0, c0, j0 = la[keep], lb[keep], c[keep].astype(np.float64), least[keep] - _EPS
        m0 = (3 * j0 - 1) * a0 * b0 / (a0 + b0)

        def lost(m: np.ndarray) -> np.ndarray:
            return a0 + b0 - 2 * m + 2 * m * (m / a0 + m / b0 + 1 - 3 * j0)

        need = np.floor(a0 / 2) - np.ceil(np.maximum(lost(m0), lost(c0))) - (0 if half else 1)
        reach = np.ceil(np.maximum(a0, b0) - m0).astype(np.int64)
        drop = np.zeros(len(keep), dtype=bool)
        worth = np.flatnonzero(need > 0)
        worth = worth[np.argsort(a0[worth], kind="stable")]
        at = 0
        while at < len(worth):       # strings of similar length together
            stop = at + int(np.searchsorted(a0[worth[at:]], 1.2 * a0[worth[at]] + 4, "right"))
            some = worth[at:min(stop, at + max(1, int(_CHARS // a0[worth[stop - 1]])))]
            found = _pieces_found([a[keep[i]] for i in some], [b[keep[i]] for i in some], int(reach[some].max()))
            drop[some] = found < need[some]
            at += len(some)
        keep = keep[~drop]
    jaro, pref4, _, _ = jaro_parts([a[i] for i in keep], [b[i] for i in keep], half)
    return keep, jaro, pref4


def _features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, counts in character groups, first four characters (-1: none)."""
    flat, lens = code_points(strings)
    n, start = len(strings), np.cumsum(lens) - lens
    small = np.int16 if lens.max(initial=0) < 1 << 14 else np.int32
    fine = np.bincount(np.repeat(np.arange(n), lens) * _FINE + flat % _FINE, minlength=n * _FINE).reshape(n, _FINE).astype(small)
    head = np.full((n, 4), -1, dtype=np.int64)
    for i in range(4):
        has = lens > i
        head[has, i] = flat[start[has] + i]
    return lens, fine, head


def _telling_steps(fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and numbers t: those on which the strings differ most in having at least t characters of the group."""
    deep = min(_DEEP, int(fine.max(initial=0)) + 1)
    held = np.bincount((np.arange(_FINE)[None, :] * deep + np.minimum(fine, deep - 1)).ravel(), minlength=_FINE * deep).reshape(_FINE, deep)
    share = held[:, ::-1].cumsum(axis=1)[:, ::-1] / max(len(fine), 1)
    share[:, 0] = 0.0
    telling = share * (1 - share)
    best = np.argsort(-telling, axis=None, kind="stable")[:_STEPS]
    best = best[telling.ravel()[best] > 0]
    return best // deep, best % deep


def contrasts(strings: DataFrame, n: int = _RINGS + 1) -> list[tuple[str, str]]:
    """``n`` pairs of sets of characters: the numbers of the one less those of the other vary most, by the
    signs of the principal components of a sample's character counts.

    The sample (column ``s``, the ``_SAMPLE`` least by hash of up to 1,000 characters) has no influence on results."""
    from collections import Counter

    rows = (strings.where((F.length("s") > 0) & (F.length("s") <= 1000)).select(F.xxhash64("s").alias("h"), "s")
            .orderBy("h", "s").limit(_SAMPLE).collect())
    texts = [r.s for r in rows]
    common = [c for c, _ in Counter("".join(texts)).most_common(_ALPHABET) if ord(c) < 1 << 16]
    column = {c: i for i, c in enumerate(common)}
    counts = np.zeros((len(texts), len(common)))
    for i, t in enumerate(texts):
        for c, k in Counter(t).items():
            if c in column:
                counts[i, column[c]] = k
    if not counts.any():
        return [("", "")] * n
    size = np.sqrt(np.maximum(counts.sum(axis=1, keepdims=True), 1))
    parts = np.linalg.svd(counts / size - size * (counts.sum(axis=0) / counts.sum()), full_matrices=False)[2]
    out = []
    for v in parts[:n]:
        heavy = np.abs(v) >= np.quantile(np.abs(v), 0.4)
        out.append(tuple("".join(c for c, x, h in zip(common, v, heavy) if h and x * sign > 0) for sign in (1, -1)))
    return out + [("", "")] * (n - len(out))


def _contrast(sets: tuple[str, str]) -> Column:
    plus, minus = sets
    return F.length(F.translate("s", minus, "")) - F.length(F.translate("s", plus, ""))


def _contrast_of(strings: list[str], sets: tuple[str, str]) -> np.ndarray:
    flat, lens = code_points(strings)
    weight = np.zeros(1 << 16, dtype=np.int64)
    for chars, w in zip(sets, (1, -1)):
        weight[[ord(c) for c in chars]] = w
    w = np.where(flat < 1 << 16, weight[np.minimum(flat, (1 << 16) - 1)], 0)
    return np.diff(np.concatenate([[0], np.cumsum(w)])[np.concatenate([[0], np.cumsum(lens)])])


def _unit_pairs(left: list[str], right: list[str], family: int, least: float, p: float, max_dist: float,
                sets: tuple[str, str] = ("", "")) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Positions, the bound of the Jaro and the common prefix of the family's pairs that pass the bound by grouped counts.

    The common characters of two strings are the steps ("at least t of a group") that both have. Those of the
    most telling steps are a matrix product; of the others there are no more than either string has."""
    (la, fa, ha), (lb, fb, hb) = _features(left), _features(right)
    own, other = _contrast_of(left, sets), _contrast_of(right, sets)
    in_left, in_right = np.argsort(own, kind="stable"), np.argsort(other, kind="stable")
    sorted_right = other[in_right]
    group, t = _telling_steps(np.concatenate([fa, fb]))
    sa, sb = ((f[:, group] >= t).astype(np.float32) for f in (fa, fb))
    more_a, more_b = (la - sa.sum(axis=1)).astype(np.float32), (lb - sb.sum(axis=1)).astype(np.float32)[in_right]
    per_a, per_b = (1 / la).astype(np.float32), (1 / lb).astype(np.float32)[in_right]
    sb = sb[in_right]
    # T is at most so much of the longer length
    reach = 3 * (1 - least) * max(la.max(), lb.max()) + 1e-6
    for at in range(0, len(left), _STRIP):
        rows = in_left[at:at + _STRIP]
        lo = np.searchsorted(sorted_right, own[rows[0]] - reach, "left")
        hi = np.searchsorted(sorted_right, own[rows[-1]] + reach, "right")
        if lo == hi:
            continue
        common = sa[rows] @ sb[lo:hi].T
        common += np.minimum(more_a[rows, None], more_b[None, lo:hi])
        # c/|a| + c/|b| >= 3J - 1; the length bound follows, as c is no more than either length
        common *= per_a[rows, None] + per_b[None, lo:hi]
        ii, jj = np.nonzero(common >= 3 * least - 1 - 1e-4)
        i, j = rows[ii], in_right[lo + jj]
        pref = ((ha[i] == hb[j]) & (ha[i] >= 0)).cumprod(axis=1).sum(axis=1)
        mine = (pref >= 2) == (family == 1)
        i, j, pref = i[mine], j[mine], pref[mine]
        x, y = la[i], lb[j]
        common = (x + y - np.abs(fa[i] - fb[j]).sum(axis=1, dtype=np.int64)) / 2
        bound = (common / x + common / y + 1) / 3
        near = bound >= 1 - max_dist / (1 - p * pref) - _EPS
        yield i[near], j[near], bound[near], pref[near]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[str]]]:
    """(family, left strings, right strings) of successive units of work."""
    key, sides = None, ([], [])
    for batch in batches:
        unit, fam, side, text = (batch.column(i).to_pylist() for i in range(4))
        for u, f, r, s in zip(unit, fam, side, text):
            if (u, f) != key:
                if key is not None:
                    yield key[1], *sides
                key, sides = (u, f), ([], [])
            sides[r].append(s)
    if key is not None:
        yield key[1], *sides


def _slices(a: list[str], b: list[str], at: np.ndarray) -> Iterator[np.ndarray]:
    """``at`` in pieces of at most ``_PENDING`` pairs and ``_CHARS`` characters."""
    chars = np.cumsum([len(a[i]) + len(b[i]) for i in at])
    start = 0
    while start < len(at):
        stop = int(np.searchsorted(chars, (chars[start - 1] if start else 0) + _CHARS, "right"))
        stop = max(start + 1, min(stop, start + _PENDING))
        yield at[start:stop]
        start = stop


def _best_pairs(a: list[str], b: list[str], owner: np.ndarray, bound: np.ndarray, pref: np.ndarray,
                settings: Sequence[tuple[float, float]], half: bool) -> tuple[np.ndarray, np.ndarray]:
    """(positions, jaro) of each owner's nearest pairs, ties included, under each (p, maxDist). ``bound``: Jaro at most.

    Pairs are scored from the most promising on; one whose bound can't reach what its owner has isn't scored."""
    p, limit = (np.array(x, dtype=np.float64) for x in zip(*settings))
    _, owner = np.unique(owner, return_inverse=True)
    scale = 1.0 - pref[:, None] * p
    at_least = (1.0 - bound)[:, None] * scale
    best = np.tile(limit, (int(owner.max()) + 1, 1))
    order = np.lexsort((at_least.min(axis=1), owner))
    rank = np.empty(len(a), dtype=np.int64)
    rank[order] = np.arange(len(a)) - np.searchsorted(owner[order], owner[order])
    jaro, dist = np.zeros(len(a)), np.full((len(a), len(p)), np.inf)
    start, stop = 0, 1
    while start <= rank.max():
        some = np.flatnonzero((rank >= start) & (rank < stop))
        some = some[(at_least[some] <= best[owner[some]] + _TIE).any(axis=1)]
        for at in _slices(a, b, some):
            jaro[at] = jaro_parts([a[i] for i in at], [b[i] for i in at], half)[0]
            dist[at] = (1.0 - jaro[at])[:, None] * scale[at]
            np.minimum.at(best, owner[at], dist[at])
        start, stop = stop, stop * 4
    near = np.flatnonzero((dist <= best[owner] + _TIE).any(axis=1))
    return near, jaro[near]


def _cell_scorer(p: float, max_dist: float, half: bool, sets: tuple[str, str], settings: Sequence[tuple[float, float]] | None = None):
    bounds = dict(zip((1, 0), jw_bounds(p, max_dist)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[str] = []
        b: list[str] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        chars = first = 0
        held = 1 if settings is None else _HELD

        def scored() -> pa.RecordBatch:
            if settings is None:
                keep, jaro, pref = _score(a, b, p, max_dist, half)
                near = jaro >= 1.0 - max_dist / (1.0 - p * pref) - 1e-6
                keep, jaro, pref = keep[near], jaro[near], pref[near]
            else:
                owner, bound, pref = (np.concatenate(x) for x in zip(*parts))
                keep, jaro = _best_pairs(a, b, owner, bound, pref, settings, half)
                pref = pref[keep]
            out = pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.string()), pa.array([b[i] for i in keep], pa.string()),
                 pa.array(jaro), pa.array(pref.astype(np.int32))], names=["sl", "sr", "jaro", "pref"])
            a.clear()
            b.clear()
            parts.clear()
            return out

        for family, left, right in _units(batches):
            if not left or not right:
                continue
            for ii, jj, bound, pref in _unit_pairs(left, right, family, bounds[family], p, max_dist, sets):
                x, y = [left[i] for i in ii.tolist()], [right[j] for j in jj.tolist()]
                other = np.fromiter((u != v for u, v in zip(x, y)), bool, len(x))
                # a strip may have very many pairs
                for at in range(0, len(x), _PENDING):
                    some = np.flatnonzero(other[at:at + _PENDING]) + at
                    a += [x[i] for i in some]
                    b += [y[i] for i in some]
                    parts.append((first + ii[some], bound[some], pref[some]))
                    chars += sum(len(x[i]) + len(y[i]) for i in some)
                    if len(a) >= held * _PENDING or chars >= held * _CHARS:
                        yield scored()
                        chars = 0
            first += len(left)
        if a:
            yield scored()
    return run


def jw_units(ls: DataFrame, rs: DataFrame, p: float, max_dist: float, rings: list[tuple[str, str]] | None = None,
             block_rows: int = _BLOCK) -> DataFrame:
    """Distinct left/right strings (column ``s``) → units of work ``unit, family, side,
    s``; each pair that can be within ``max_dist`` meets in a unit. ``rings``: contrasts."""
    both = _listed(ls, rs, p, max_dist, rings)
    return _dealt(both, _cell_sizes(both, block_rows))


def _listed(ls: DataFrame, rs: DataFrame, p: float, max_dist: float, rings: list[tuple[str, str]] | None = None) -> DataFrame:
    """``cell, family, side, s``: the cells of each string."""
    if rings is None:
        rings = contrasts(ls.unionByName(rs), _RINGS)
    loose, tight = jw_bounds(p, max_dist)

    def listed(df: DataFrame, side: int) -> DataFrame:
        out = []
        for family, least, parts in ((1, loose, 2), (0, tight, 2)):
            k = 3.0 * least - 2.0
            step = math.log(1.0 / k) / parts
            band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + F.lit(1e-9))
            rows = df.where(F.length("s") > (1 if family else 0)).withColumn("n", F.length("s"))
            # left strings in their own band; right ones where lengths from k n to n / k lie
            bands = F.array(band) if side == 0 else F.sequence(
                F.floor(F.log(F.col("n") * F.lit(k)) / F.lit(step) - F.lit(1e-6)),
                F.floor(F.log(F.col("n") / F.lit(k)) / F.lit(step) + F.lit(1e-6)))
            used = [] if family else rings
            rows = rows.select("s", "n", *[_contrast(r).alias(f"f{i}") for i, r in enumerate(used)], F.explode(bands).alias("band"))
            low, top = (F.exp((F.col("band") + x) * F.lit(step)) for x in (0, 1))
            width = F.greatest(F.lit(1.0), F.ceil(F.lit(1 - k) * top).cast("double"))

            def most_apart(a: Column) -> Column:
                return a + F.col("n") - 2 * F.lit(3 * least - 1) * a * F.col("n") / (a + F.col("n"))    # noqa: B023

            # T is convex in the left length, so largest at an end of those that the band and the string admit
            reach = F.greatest(most_apart(F.greatest(low, F.lit(k) * F.col("n"))), most_apart(F.least(top, F.col("n") / F.lit(k)))) + F.lit(1e-3)
            for i in range(len(used)):
                ring = F.array(F.floor(F.col(f"f{i}") / width)) if side == 0 else F.sequence(
                    F.floor((F.col(f"f{i}") - reach) / width), F.floor((F.col(f"f{i}") + reach) / width))
                rows = rows.withColumn(f"r{i}", F.explode(ring))
            out.append(rows.select("s", F.lit(family).alias("family"), F.lit(side).alias("side"), F.xxhash64(
                F.lit(family), F.substring("s", 1, 2) if family else F.lit(""), "band", *[f"r{i}" for i in range(len(used))]).alias("cell")))
        return out[0].unionByName(out[1]).select("cell", "family", "side", "s")

    return listed(ls, 0).unionByName(listed(rs, 1))


def _cell_sizes(both: DataFrame, block_rows: int) -> DataFrame:
    """``cell, family``, the blocks ``bl``, ``br`` that its sides are dealt to, ``bytes`` of all copies (about) and ``pairs``."""
    left, n = 1 - F.col("side"), F.length("s").cast("long")
    sizes = (both.groupBy("cell", "family").agg(F.sum(left).alias("nl"), F.sum("side").alias("nr"), F.sum(left * n).alias("cl"),
                                                F.sum(F.col("side") * n).alias("cr")).where("nl > 0 and nr > 0"))
    blocks = [F.greatest(F.ceil(F.col(x) / block_rows), F.ceil(F.col(c) / _BLOCK_CHARS)).cast("int") for x, c in (("nl", "cl"), ("nr", "cr"))]
    return (sizes.withColumn("bl", blocks[0]).withColumn("br", blocks[1])
            .withColumn("bytes", (F.col("cl") + _ROW_BYTES * F.col("nl")) * F.col("br") + (F.col("cr") + _ROW_BYTES * F.col("nr")) * F.col("bl"))
            .withColumn("pairs", F.col("nl").cast("double") * F.col("nr")).select("cell", "family", "bl", "br", "bytes", "pairs"))


def _dealt(both: DataFrame, sizes: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """The units of one part of the pairs of a cell and a left block."""
    def here(x: Column) -> Column:
        return F.pmod(F.xxhash64("cell", "family", x.cast("long")), F.lit(parts)) == part

    is_left = F.col("side") == 0
    rows = (both.join(sizes.drop("bytes", "pairs"), ["cell", "family"])
            .withColumn("own", F.pmod(F.xxhash64("s"), F.when(is_left, F.col("bl")).otherwise(F.col("br")))))
    others = F.sequence(F.lit(0), F.when(is_left, F.col("br")).otherwise(F.col("bl")) - 1)
    if parts > 1:
        rows = rows.where(~is_left | here(F.col("own")))
        others = F.when(is_left, others).otherwise(F.filter(others, here))
    dealt = rows.withColumn("other", F.explode(others))
    x = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    y = F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    return dealt.select(F.xxhash64("cell", x.cast("long"), y.cast("long")).alias("unit"), "family", "side", "s")


def jw_scored(ls: DataFrame, rs: DataFrame, p: float, max_dist: float, half_transpositions: bool = True,
              block_rows: int = _BLOCK, settings: Sequence[tuple[float, float]] | None = None,
              round_bytes: int = _ROUND) -> DataFrame:
    """Pairs ``sl, sr, jaro, pref`` of distinct strings (column ``s``) that are within
    ``max_dist``, or closely beyond it. With ``settings`` (p, maxDist): of these pairs at least each left
    string's nearest under each setting, all that tie included.

    The copies of strings in all units grow with the square of the strings. If they are more than ``round_bytes``, and more than
    ``_ROUND_X`` times the strings, the units are worked off in rounds, each of which gives its shuffle's disk back while the next one runs: two are held at a time."""
    spark = ls.sparkSession
    ls, rs = (stage_parquet(df.select("s"), staging_path(spark, f"jw_{name}")) for name, df in (("left", ls), ("right", rs)))
    *rings, inner = contrasts(ls.unionByName(rs))
    both = _listed(ls, rs, p, max_dist, rings)
    sizes = stage_parquet(_cell_sizes(both, block_rows), staging_path(spark, "jw_cells"))
    copies, n_pairs = (x or 0 for x in sizes.agg(F.sum("bytes"), F.sum("pairs")).first())
    strings = ls.unionByName(rs).agg(F.sum(F.length("s") + F.lit(_ROW_BYTES))).first()[0] or 0
    rounds = max(1, math.ceil(copies / max(round_bytes, _ROUND_X * strings)))
    # a number of tasks by the work, which partitions joined by their bytes would undo
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(_TASKS, math.ceil(n_pairs / rounds / _TASK_PAIRS)))

    def scored(part: int) -> DataFrame:
        units = _dealt(both, sizes, part, rounds).repartition(tasks, "unit", "family").sortWithinPartitions("unit", "family", "side")
        return units.mapInArrow(_cell_scorer(p, max_dist, half_transpositions, inner, settings),
                                "sl string, sr string, jaro double, pref int")

    if rounds == 1:
        pairs = scored(0)
    else:
        folder = staging_path(spark, "jw_pairs")
        for part in range(rounds):
            scored(part).write.parquet(f"{folder}/round={part}")
            _release(spark)
        pairs = spark.read.parquet(folder).drop("round")
    equal = (ls.select(F.col("s").alias("sl")).join(rs.select(F.col("s").alias("sr")), F.col("sl") == F.col("sr"))
             .select("sl", "sr", F.lit(1.0).alias("jaro"), F.least(F.length("sl"), F.lit(4)).alias("pref")))
    return pairs.unionByName(equal)


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # a remote session: its server cleans up
        pass


def winkler_distance(p: float) -> Column:
    """The rounded distance of scored pairs under a prefix weight."""
    return F.when(F.col("sl") == F.col("sr"), F.lit(0.0)).otherwise(
        F.round((1 - F.col("jaro")) * (1 - F.lit(float(p)) * F.col("pref")), ROUND_DIGITS))


def link_fuzzy_jw(left: DataFrame, right: DataFrame, by: str, left_key: str, right_key: str,
                  suffixes: Sequence[str] = ("_1", "_2"), p: float = 0.1, max_dist: float = 0.05,
                  half_transpositions: bool = True, by_right: str | None = None,
                  keep_dist: bool = False) -> DataFrame:
    """Best right row per left row by Jaro-Winkler distance, ``d <= max_dist``.

    Defaults are the matching library's (``p = 0.1``, ``maxDist = 0.05``).
    Distances are rounded to 9 places before comparing and ranking; ties go
    to the smallest right key.
    """
    scored = jw_scored_pairs(left, right, by, [(p, max_dist)], by_right, half_transpositions)
    return link_from_scored(scored, 0, max_dist, left, right, by, left_key, right_key, suffixes, by_right, keep_dist)


def jw_scored_pairs(left: DataFrame, right: DataFrame, by: str, settings, by_right: str | None = None,
                    half_transpositions: bool = True) -> DataFrame:
    """Score distinct string pairs once for several (p, maxDist) settings →
    (sl, sr, ds) with ``ds[i]`` the distance under ``settings[i]``: at least each left
    string's nearest pairs under each of them.

    Candidates use the loosest bound (largest p and maxDist), which contains
    the candidates of every setting; stages that differ only in settings (or
    run on a subset of the left rows) can share the result."""
    by_right = by_right or by
    ls = left.select(F.col(by).alias("s")).where(F.col("s").isNotNull()).distinct()
    rs = right.select(F.col(by_right).alias("s")).where(F.col("s").isNotNull()).distinct()
    settings = [(float(p), float(d)) for p, d in settings]
    scored = jw_scored(ls, rs, max(p for p, _ in settings), max(d for _, d in settings), half_transpositions, settings=settings)
    return scored.select("sl", "sr", F.array(*[winkler_distance(p) for p, _ in settings]).alias("ds"))


def link_from_scored(scored: DataFrame, index: int, max_dist: float, left: DataFrame,
                     right: DataFrame, by: str, left_key: str, right_key: str,
                     suffixes: Sequence[str] = ("_1", "_2"), by_right: str | None = None,
                     keep_dist: bool = False) -> DataFrame:
    """Best-1 linkage of ``left`` rows from shared scored pairs (setting ``index``)."""
    pairs = (scored.select("sl", "sr", F.try_element_at("ds", F.lit(index + 1)).alias("d"))
             .where(F.col("d") <= F.lit(round(max_dist, ROUND_DIGITS))))
    best = best_per_left(pairs, left, right, by, by_right or by, left_key, right_key)
    return attach_sides(best, left, right, left_key, right_key, suffixes, ["dist"] if keep_dist else [])
