"""Jaro / Jaro-Winkler distance on code points, vectorised over Arrow batches.

Spark has no Jaro function, so this is the one scorer that runs in Python.
It is applied only to candidate pairs that pass the bounds of
:mod:`termlink.operators.linkage`; pairs of similar length are scored together
with numpy (one pass per character position, not per pair).

Definition (stringdist's ``jw``): window ``max(0, floor(max(|a|,|b|)/2) - 1)``,
greedy left-to-right matching, ``t`` = half the matched characters that are
out of order, ``jaro = (m/|a| + m/|b| + (m-t)/m) / 3`` (0 when ``m = 0``),
``d = (1 - jaro) * (1 - p*l)`` with ``l`` the common prefix, at most 4, and
no boost threshold. Equal strings (also two empty ones) have ``d = 0``.
``half_transpositions=False`` floors ``t`` instead (strcmp95 convention).
"""

from __future__ import annotations

import numpy as np

# Ship this module's code with the UDF (by value), so executors need no copy
# of the package on their path.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

ROUND_DIGITS = 9
_CELL_BUDGET = 4_000_000  # pairs * max_len cells per numpy chunk
_BIT_CHARS = 4096         # up to this length the places of a character are bits of whole numbers
_BIT_PAIRS = 1024         # pairs whose places are held together, if
_BIT_WORDS = 1 << 22      # that are so many numbers at most
_BIT_LEAST = 32           # pairs for which the places are worth their making


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the strings' lengths."""
    lens = np.fromiter((len(s) for s in strings), dtype=np.int64, count=len(strings))
    return np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32), lens


def small_codes(flat: np.ndarray) -> tuple[np.ndarray, int]:
    """Code points numbered from 0 without gaps, and how many there are."""
    present = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
    present[flat] = True
    return (np.cumsum(present) - 1)[flat], int(present.sum())


def padded_codes(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of small codes for characters, equal for equal characters, and
    the lengths. Codes start at 2; ``a`` is padded with 0 and ``b`` with 1."""
    flat, lens = code_points([*a, *b])
    codes, used = small_codes(flat)
    size = used + 2
    dtype = np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.uint32
    out = []
    at = 0
    for pad, own in ((0, lens[:len(a)]), (1, lens[len(a):])):
        m = np.full((len(own), max(int(own.max(initial=0)), 1)), pad, dtype=dtype)
        total = int(own.sum())
        m[np.arange(m.shape[1])[None, :] < own[:, None]] = codes[at:at + total] + 2
        at += total
        out += [m, own]
    return out[0], out[2], out[1], out[3]


def _jaro_chunk(a: list[str], b: list[str], half: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    # longest first, so that the pairs that still have an i-th character are the first ones
    order = sorted(range(n), key=lambda i: -len(a[i]))
    A, B, la, lb = padded_codes([a[i] for i in order], [b[i] for i in order])
    window = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    at_once = min(_BIT_PAIRS, _BIT_WORDS // (-(-B.shape[1] // 64) * (int(max(A.max(initial=0), B.max(initial=0))) + 1)))
    if B.shape[1] <= _BIT_CHARS and at_once >= _BIT_LEAST:
        a_used, b_used = (np.concatenate(x) for x in zip(*(
            _matched_bits(*(x[at:at + at_once] for x in (A, B, la, lb, window))) for at in range(0, n, at_once))))
    else:
        a_used, b_used = _matched(A, B, la, lb, window)
    m = a_used.sum(axis=1)
    # k-th matched character of a against k-th matched character of b
    ra, ca = np.nonzero(a_used)
    rb, cb = np.nonzero(b_used)
    mism = np.bincount(ra[A[ra, ca] != B[rb, cb]], minlength=n)     # both in (pair, position) order, equally many a pair
    t = mism / 2.0 if half else np.floor_divide(mism, 2).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1)
                                + (m - t) / np.maximum(m, 1)) / 3.0, 0.0)
    # common prefix, at most 4 (paddings differ)
    k = min(4, A.shape[1], B.shape[1])
    pref = np.zeros(n, dtype=np.int64)
    still = np.ones(n, dtype=bool)
    for i in range(k):
        still &= A[:, i] == B[:, i]
        pref += still
    back = np.argsort(order)
    return jaro[back], pref[back]


def _matched(A: np.ndarray, B: np.ndarray, la: np.ndarray, lb: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which characters of either side are matched; pairs come longest ``a`` first."""
    n = len(A)
    small = np.int16 if B.shape[1] < 1 << 14 else np.int32
    jpos = np.arange(B.shape[1], dtype=small)[None, :]
    free = np.ones(B.shape, dtype=bool)
    a_used = np.zeros(A.shape, dtype=bool)
    rows = np.arange(n)
    for i in range(A.shape[1]):
        live = int(np.searchsorted(-la, -i, "left"))
        if not live:
            break
        lo = np.maximum(0, i - window[:live]).astype(small)
        hi = np.minimum(lb[:live], i + window[:live] + 1).astype(small)
        x, y = int(lo.min()), int(hi.max())
        if y <= x:
            continue
        cand = B[:live, x:y] == A[:live, i:i + 1]
        cand &= free[:live, x:y]
        # only the columns that are outside some pair's window need a mask
        x1, y1 = int(lo.max()), int(hi.min())
        if x1 > x:
            cand[:, :x1 - x] &= jpos[:, x:min(x1, y)] >= lo[:, None]
        if y1 < y:
            cand[:, max(0, y1 - x):] &= jpos[:, max(x, y1):y] < hi[:, None]
        first = cand.argmax(axis=1)
        has = cand[rows[:live], first]
        free[rows[:live][has], x + first[has]] = False
        a_used[:live, i] = has
    return a_used, ~free


def _matched_bits(A: np.ndarray, B: np.ndarray, la: np.ndarray, lb: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, with the places of each character in ``b`` as bits of 64-bit numbers."""
    n, one, full = len(A), np.uint64(1), np.uint64(2 ** 64 - 1)
    words, width = -(-B.shape[1] // 64), int(max(A.max(initial=0), B.max(initial=0))) + 1
    start = np.arange(n) * width
    places = np.zeros((words, n * width), dtype=np.uint64)
    for j in range(B.shape[1]):
        places[j >> 6, start + B[:, j]] |= np.uint64(1 << (j & 63))
    places[:, start + 1] = 0                    # the padding
    done = np.full((words, n), full)
    bits = (window + 1)[None, :] - 64 * np.arange(words)[:, None]
    near = np.where(bits >= 64, full, (one << np.clip(bits, 0, 63).astype(np.uint64)) - one)   # of a's first character
    free = np.full((words, n), full)
    a_used = np.zeros((A.shape[1], n), dtype=bool)
    columns = np.ascontiguousarray(A.T)
    for i in range(A.shape[1]):
        live = int(np.searchsorted(-la, -i, "left"))
        if not live:
            break
        if live < near.shape[1]:
            done[:, live:near.shape[1]] = free[:, live:] if i else full
            near, free = np.ascontiguousarray(near[:, :live]), np.ascontiguousarray(free[:, :live])
        x = places.take(start[:live] + columns[i, :live], axis=1)
        x &= near
        x &= free
        first = x & (~x + one)
        has = x[0] != 0
        for k in range(1, words):
            first[k] *= ~has
            has |= x[k] != 0
        free ^= first
        a_used[i, :live] = has
        # the window's upper end moves on with each character, its lower end after ``window`` of them
        come = near >> np.uint64(63)
        near <<= one
        near[1:] |= come[:-1]
        near[0] |= i < window[:live]
    done[:, :free.shape[1]] = free
    used, a_used = ~done, a_used.T
    b_used = np.unpackbits(np.ascontiguousarray(used.T).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return a_used, b_used[:, :B.shape[1]].astype(bool)


def jaro_parts(a, b, half_transpositions: bool = True):
    """(jaro, common prefix <= 4, equal, valid) arrays for aligned string
    sequences; one Jaro pass, reusable for any prefix weight."""
    a = list(a)
    b = list(b)
    n = len(a)
    jaro = np.zeros(n)
    pref = np.zeros(n, dtype=np.int64)
    same = np.zeros(n, dtype=bool)
    ok = np.array([x is not None and y is not None for x, y in zip(a, b)], dtype=bool)
    idx = np.nonzero(ok)[0]
    if idx.size:
        width = np.array([max(len(a[i]), len(b[i]), 1) for i in idx])
        order = idx[np.argsort(width, kind="stable")]
        start = 0
        while start < order.size:
            w = max(len(a[order[start]]), len(b[order[start]]), 1)
            # chunk so that pairs * width stays inside the budget (widths ascend)
            stop = start + 1
            while stop < order.size and (stop - start + 1) * max(
                    len(a[order[stop]]), len(b[order[stop]]), w) <= _CELL_BUDGET and (
                    stop - start < _BIT_PAIRS or max(len(a[order[stop]]), len(b[order[stop]])) > _BIT_CHARS):
                stop += 1
            sel = order[start:stop]
            j, pr = _jaro_chunk([a[i] for i in sel], [b[i] for i in sel], half_transpositions)
            jaro[sel] = j
            pref[sel] = pr
            same[sel] = np.array([a[i] == b[i] for i in sel], dtype=bool)
            start = stop
    return jaro, pref, same, ok


def _distance(parts, p: float, digits: int | None) -> np.ndarray:
    jaro, pref, same, ok = parts
    d = (1.0 - jaro) * (1.0 - p * pref)
    d[same] = 0.0
    d[~ok] = np.nan
    return np.round(d, digits) if digits is not None else d


def jaro_winkler_distance(a, b, p: float = 0.1, half_transpositions: bool = True,
                          digits: int | None = ROUND_DIGITS) -> np.ndarray:
    """Distance for aligned sequences ``a``/``b`` of strings (None → NaN)."""
    return _distance(jaro_parts(a, b, half_transpositions), p, digits)


def jaro_similarity(a, b, half_transpositions: bool = True) -> np.ndarray:
    """Plain Jaro similarity (p = 0)."""
    return 1.0 - jaro_winkler_distance(a, b, p=0.0, half_transpositions=half_transpositions,
                                       digits=None)
