"""Vectorised scanning of whole texts inside Arrow batches.

Texts are taken as the UTF-8 bytes that Arrow holds.  A byte table gives each
byte a class; a token is a longest run of bytes of one class other than 0
within one text.  All bytes of non-ASCII characters are >= 0x80, so byte
classes that treat these alike never cut a character.

Tokens are hashed by a polynomial over prefix sums modulo 2**64: one pass over
the bytes, whatever the number of tokens.  The hashes only preselect; callers
that need exact equality compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are scanned in slices of about so many bytes (a longer text alone).
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

#: Everything but ASCII white space (0x20, 0x09-0x0D) is one class.
NON_SPACE = np.ones(256, dtype=np.uint8)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = 0

#: ASCII digits and letters and all non-ASCII characters.
WORD = np.zeros(256, dtype=np.uint8)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = 1

#: 1 letters (ASCII and non-ASCII), 2 digits, 3 other visible characters.
SHAPE = np.full(256, 3, dtype=np.uint8)
SHAPE[:0x21] = SHAPE[0x7F] = 0
SHAPE[0x30:0x3A] = 2
SHAPE[0x41:0x5B] = SHAPE[0x61:0x7B] = SHAPE[0x80:] = 1

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {"pow": np.ones(1, U64), "inv": np.ones(1, U64)}


class Tokens(NamedTuple):
    """Tokens of a slice of texts.

    low: the bytes, A-Z lower-cased; start, end: byte bounds of each token;
    first: for text i its tokens are ``first[i]:first[i + 1]``."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def words(self, i: int, j: int) -> list[bytes]:
        return [self.low[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j])]


def slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from row, to row, bytes, offsets)`` of successive slices; a null text
    counts as an empty one."""
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0:
        return
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset: col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        yield i, j, raw[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        i = j


def tokens(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> Tokens:
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Tokens(data, none, none, np.zeros(len(offs), np.int64))
    kind = classes[data]
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[offs[:-1][offs[:-1] < n]] = True
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], n)
    keep = kind[begin] > 0
    start, end = begin[keep], stop[keep]
    return Tokens(LOWER[data], start, end, np.searchsorted(start, offs))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), element by element."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["pow"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("pow", _BASE), ("inv", _INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _tables[key] = np.cumprod(steps, dtype=U64)
    return _tables["pow"], _tables["inv"]


def token_hashes(t: Tokens) -> np.ndarray:
    """A 64-bit hash of each token's lower-cased bytes."""
    n = len(t.low)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((t.low.astype(U64) + U64(1)) * power[:n], out=sums[1:])
    h = (sums[t.end] - sums[t.start]) * inverse[t.start]
    return mix(h ^ ((t.end - t.start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def text_of_token(t: Tokens) -> np.ndarray:
    """The number of each token's text within the slice."""
    return np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k tokens from each token on, text bounds not regarded;
    shorter than ``h`` by k - 1."""
    n = max(0, len(h) - k + 1)
    g = np.full(n, U64(k), dtype=U64)
    for j in range(k):
        g = g * U64(0xC2B2AE3D27D4EB4F) + h[j: j + n]
    return mix(g)
