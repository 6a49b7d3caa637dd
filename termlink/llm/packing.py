"""Token-id output: best-fit-decreasing packing into rows of equal length.

Texts are encoded as ordinary text with a byte-level BPE vocabulary, an
end-of-text id follows each, and the id sequence of a document is cut into
segments of at most ``length`` ids, so nothing is lost or cut off.  Full
segments are rows of their own.  The rest is packed longest first, each
segment into the fullest row that has room; a segment tree over capacities finds
that row in log(length) steps.

Documents are packed where they are read: each task fills a block of at
least ``block_tokens`` ids (and at most one document more), packs it, emits its
rows and goes on.  Nothing is shuffled, memory is bounded by the block and
the longest text, and a task that is run again gives the same rows.  The
rows therefore depend on how the input is split, the ids of a document don't.

Each row holds its part of the matrix and what an attention kernel needs:

* ``input_ids``: ``length`` little-endian unsigned integers of ``id_bytes`` bytes
  (2 if all ids fit, else 4), padded with the pad id;
* ``position_ids``: as many 4-byte integers, from 0 anew in each segment;
* ``cu_seqlens``: cumulative segment lengths from 0 to ``n_tokens``;
* ``doc_ids``, ``parts``: the document of each segment, and the
  segment's number in it.

Edge cases: null and empty texts have no ids and appear in no row; a null
doc_id is carried as null; repeated rows are packed as often as they
occur; ids keep their type; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from termlink.llm.tables import small_text_batches

#: ID stands for the type of the documents' ids.
SCHEMA = ("shard int, pack long, n_tokens int, n_segments int, id_bytes int, input_ids binary, "
          "position_ids binary, cu_seqlens array<int>, doc_ids array<ID>, parts array<int>")


def _arrow(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("pack", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()),
                      ("id_bytes", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()),
                      ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(id_type)), ("parts", pa.list_(pa.int32()))])


_EMIT = 256


class Capacities:
    """How many open rows have each remaining capacity, as a segment tree of
    counts: ``fit`` finds the least capacity that has a row and is enough."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def fit(self, need: int) -> int:
        """-1 if there is none."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1 and not (i % 2 == 0 and self.count[i + 1]):
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of positions in ``lengths``; longest first, ties in given order."""
    open_rows: list[list[int]] = [[] for _ in range(length + 1)]
    tree, rows = Capacities(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        room = tree.fit(need)
        if room < 0:
            rows.append([])
            r, room = len(rows) - 1, length
        else:
            r = open_rows[room].pop()
            tree.add(room, -1)
        rows[r].append(i)
        if room > need:
            open_rows[room - need].append(r)
            tree.add(room - need, 1)
    return rows


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """The vocabulary of ``path``: base64 pieces and ranks, a pair a line."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _packed(parts: list[tuple[int | None, int, np.ndarray]], length: int, dtype: str, pad: int,
            shard: int, pack: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of packed rows of a block of segments (doc_id, part, ids)."""
    full = [[i] for i, p in enumerate(parts) if len(p[2]) == length]
    rest = [i for i, p in enumerate(parts) if len(p[2]) < length]
    rows = full + [[rest[i] for i in r] for r in best_fit([len(parts[i][2]) for i in rest], length)]
    for at in range(0, len(rows), _EMIT):
        out: dict[str, list] = {n: [] for n in schema.names}
        for r in rows[at: at + _EMIT]:
            ids = np.full(length, pad, dtype=dtype)
            positions = np.zeros(length, dtype="<u4")
            ends = [0]
            for i in r:
                x = parts[i][2]
                ids[ends[-1]: ends[-1] + len(x)] = x
                positions[ends[-1]: ends[-1] + len(x)] = np.arange(len(x))
                ends.append(ends[-1] + len(x))
            for name, value in zip(schema.names, (
                    shard, pack, ends[-1], len(r), ids.itemsize, ids.tobytes(), positions.tobytes(), ends,
                    [parts[i][0] for i in r], [parts[i][1] for i in r])):
                out[name].append(value)
            pack += 1
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def pack(docs: DataFrame, vocabulary: str, pattern: str, length: int = 2048, end_id: int | None = 50256,
         pad_id: int = 50256, block_tokens: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of ``docs`` (see the module's text).  shard: the task that made
    a row; pack: the row's number in it."""
    if length < 1 or block_tokens < 1:
        raise ValueError("length and block_tokens must be positive")
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        top = max(enc.max_token_value, pad_id, end_id or 0)
        dtype = "<u2" if top < 1 << 16 else "<u4"
        shard = TaskContext.get().partitionId()
        parts: list[tuple[int | None, int, np.ndarray]] = []
        held = done = 0
        schema = _arrow(pa.int64())
        for b in batches:
            schema = _arrow(b.column(0).type)
            for doc_id, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                ids = np.array(enc.encode_ordinary(text), dtype=dtype)
                if end_id is not None:
                    ids = np.append(ids, np.array(end_id, dtype=dtype))
                parts += [(doc_id.as_py(), n, ids[i: i + length]) for n, i in enumerate(range(0, len(ids), length))]
                held += len(ids)
                if held >= block_tokens:
                    for out in _packed(parts, length, dtype, pad_id, shard, done, schema):
                        done += out.num_rows
                        yield out
                    parts, held = [], 0
        yield from _packed(parts, length, dtype, pad_id, shard, done, schema)

    own = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return own.mapInArrow(run, SCHEMA.replace("ID", own.schema["doc_id"].dataType.simpleString()))
