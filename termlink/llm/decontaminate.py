"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item.  Of each run of
``window - gram + 1`` consecutive k-grams (k = ``gram``) the ones with the least
hash are kept as fingerprints, on both sides.  A window shared by a document and
an item spans exactly one such run, so both sides keep the same k-gram of it:
every shared window is found.  Fingerprints are joined by hash, then each hit is
verified and extended word by word to the left and right; an extended run of at
least ``window`` words consists of shared windows.

An item with fewer words than a window is one window as a whole and is looked
up by the hash of all its words, one hash per such length.

Before the join, documents drop fingerprints whose hash isn't in a bitmap of
the benchmark's: a table of fixed size (``filter_bits``), whatever the
benchmark's, built by Spark.  It has no false negatives; a benchmark
that fills it makes the join larger and changes no result.

Edge cases: null or empty texts have no words and no hits; items without words
have no window; items with a null item_id mark words but are not listed or
counted; repeated rows are returned as often as they occur, repeated item_ids
count once; an empty benchmark leaves every document clean; other columns of
either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termlink.llm import words
from termlink.llm.tables import small_text_batches, staged

_U = np.uint64
#: Positions of one text that are put in one row at most; further ones get
#: further rows.
_ROW_HITS = 4096
_FP = "array<struct<h:long,size:int,lead:int,context:string,at:array<int>>>"


def _selected(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Starts of the k-grams with the least hash of some window, and all their hashes."""
    n = len(h) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    g = words.gram_hashes(h, gram)
    runs = window - gram + 1
    m = len(h) - window + 1
    keep = np.zeros(n, dtype=bool)
    if m > 0:
        ends = np.repeat(first[1:], np.diff(first))[:m]
        whole = ends - np.arange(m) >= window
        least = g[:m].copy()
        for j in range(1, runs):
            np.minimum(least, g[j: j + m], out=least)
        for j in range(runs):
            keep[j: j + m] |= whole & (g[j: j + m] == least)
    at = np.flatnonzero(keep)
    return at, g[at]


def _whole_grams(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all grams of ``size`` words that lie in one text."""
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    ends = np.repeat(first[1:], np.diff(first))[:m]
    at = np.flatnonzero(ends - np.arange(m) >= size)
    return at, words.gram_hashes(h, size)[at]


def _rows(t: words.Tokens, picks: list[tuple[int, int, np.ndarray, np.ndarray]]) -> list[dict[tuple, list[int]]]:
    """Per text: (hash, size, lead, context) -> positions in the text.
    picks: (size, reach, starts, hashes); the context reaches ``reach`` words
    beyond the gram on either side, as far as the text does."""
    out: list[dict[tuple, list[int]]] = [{} for _ in range(len(t.first) - 1)]
    for size, reach, at, hashes in picks:
        rows = np.searchsorted(t.first, at, "right") - 1
        for i, r, x in zip(at.tolist(), rows.tolist(), hashes.astype(np.int64).tolist()):
            lo, hi = max(int(t.first[r]), i - reach), min(int(t.first[r + 1]), i + size + reach)
            key = (x, size, i - lo, b" ".join(t.words(lo, hi)).decode())
            out[r].setdefault(key, []).append(i - int(t.first[r]))
    return out


def fingerprints(texts: DataFrame, key: str, window: int, gram: int, short: list[int],
                 bitmap=None, bits: int = 0, items: bool = False) -> DataFrame:
    """``key, n_words, hits`` for each row of ``texts`` (columns key, text).

    items: the short texts among them are windows as a whole; otherwise the
    lengths in ``short`` are looked up at every place.  bitmap: broadcast bytes
    of the hashes to keep, by their upper ``bits`` bits."""
    small_text_batches(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = None if bitmap is None else np.frombuffer(bitmap.value, dtype=np.uint8)

        def known(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if mask is None:
                return at, h
            top = (h >> _U(64 - bits)).astype(np.int64)
            hit = (mask[top >> 3] >> (top & 7).astype(np.uint8)) & 1 > 0
            return at[hit], h[hit]

        for b in batches:
            for i, j, data, offs in words.slices(b.column(1)):
                t = words.tokens(data, offs, words.WORD)
                h = words.token_hashes(t)
                n = np.diff(t.first)
                picks = [(gram, reach, *known(*_selected(h, t.first, window, gram)))]
                for size in short:
                    at, x = _whole_grams(h, t.first, size)
                    if items:
                        whole = np.repeat(n, n)[at] == size
                        at, x = at[whole], x[whole]
                    picks.append((size, 0, *known(at, x)))
                found = [[{"h": k[0], "size": k[1], "lead": k[2], "context": k[3], "at": v[p: p + _ROW_HITS]}
                          for k, v in hits.items() for p in range(0, len(v), _ROW_HITS)] for hits in _rows(t, picks)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(found, type=_HITS)],
                    names=[key, "n_words", "hits"])

    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, n_words long, hits {_FP}")


_HITS = pa.list_(pa.struct([("h", pa.int64()), ("size", pa.int32()), ("lead", pa.int32()),
                            ("context", pa.string()), ("at", pa.list_(pa.int32()))]))


def _bitmap(prints: DataFrame, bits: int):
    """A bitmap of the hashes' upper bits, of 2**bits bits."""
    spark = prints.sparkSession
    at = prints.select((F.shiftrightunsigned("h", 64 - bits) + 1).alias("n"))
    parts = (at.groupBy(F.expr("bitmap_bucket_number(n)").alias("bucket"))
             .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(n))").alias("part")))
    out = bytearray(1 << (bits - 3))
    for r in parts.toLocalIterator():       # 2**bits / 32768 rows of 4 kB at most
        out[(r.bucket - 1) * 4096: r.bucket * 4096] = r.part
    return spark.sparkContext.broadcast(bytes(out))


def _same(a: Column, i: Column, b: Column, j: Column) -> Column:
    """1 if both places exist and hold the same word, else 0."""
    inside = (i >= 0) & (j >= 0)
    return F.when(inside & (F.get(a, F.when(i >= 0, i)) == F.get(b, F.when(j >= 0, j))), 1).otherwise(0)


def _extent(a: Column, i: Column, b: Column, j: Column, step: int, reach: int) -> Column:
    """How many words agree in succession, going by ``step`` from beside i and j."""
    total, run = F.lit(0), F.lit(1)
    for d in range(1, reach + 1):
        run = run * _same(a, i + step * d, b, j + step * d)
        total = total + run
    return total


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 7, filter_bits: int = 26,
         id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, spans, listed)``: documents ``row, doc_id, n_words``; spans
    ``row, start, end`` of words of shared windows (they may overlap); listed
    ``row, item_id``, distinct.  ``row`` numbers the rows of ``docs``."""
    if not 0 < gram <= window or not 15 <= filter_bits <= 30:
        raise ValueError("need 0 < gram <= window and 15 <= filter_bits <= 30")
    spark = docs.sparkSession
    reach = window - gram
    items = staged(
        fingerprints(benchmark.select("item_id", "text"), "item_id", window, gram,
                     list(range(1, window)), items=True)
        .select("item_id", "n_words", F.explode("hits").alias("x"))
        .select("item_id", "n_words", "x.h", "x.size", "x.lead", "x.context",
                F.md5(F.concat_ws("|", "x.size", "x.lead", "x.context")).alias("print")), "bench-prints")
    # at most window - 1 numbers
    short = sorted(r[0] for r in items.where(F.col("n_words") < window).select("size").distinct().collect())
    bitmap = _bitmap(items, filter_bits)

    keyed = docs.select(F.struct(F.monotonically_increasing_id().alias("row"),
                                 F.col(id_col).alias("doc_id")).alias("k"), F.col(text_col).alias("text"))
    found = staged(fingerprints(keyed, "k", window, gram, short, bitmap, filter_bits)
                   .select("k.row", "k.doc_id", "n_words", "hits"), "doc-prints")
    mine = (found.select("row", F.explode("hits").alias("x"))
            .select("row", "x.h", F.col("x.size").alias("size"), F.col("x.lead").alias("d_lead"),
                    F.split("x.context", " ").alias("d"), F.col("x.at").alias("at")))
    theirs = (items.select("h", "size", F.col("lead").alias("i_lead"), F.split("context", " ").alias("i"), "print")
              .distinct())
    met = mine.join(theirs, ["h", "size"]).where(
        F.slice("d", F.col("d_lead") + 1, F.col("size")) == F.slice("i", F.col("i_lead") + 1, F.col("size")))
    left = _extent(F.col("d"), F.col("d_lead"), F.col("i"), F.col("i_lead"), -1, reach)
    right = _extent(F.col("d"), F.col("d_lead") + F.col("size") - 1, F.col("i"),
                    F.col("i_lead") + F.col("size") - 1, 1, reach)
    met = (met.withColumn("left", left).withColumn("right", right)
           .withColumn("whole_item", (F.size("i") == F.col("size")))
           .where(F.col("whole_item") | (F.col("left") + F.col("size") + F.col("right") >= window))
           .withColumn("left", F.when(F.col("whole_item"), 0).otherwise(F.col("left")))
           .withColumn("right", F.when(F.col("whole_item"), 0).otherwise(F.col("right"))))
    spans = (met.select("row", "left", "right", "size", F.explode("at").alias("p"))
             .select("row", (F.col("p") - F.col("left")).alias("start"),
                     (F.col("p") + F.col("size") + F.col("right")).alias("end")).distinct())
    listed = (met.select("row", "print").distinct()
              .join(items.select("print", "item_id").where("item_id is not null").distinct(), "print")
              .select("row", "item_id").distinct())
    return found.select("row", "doc_id", "n_words"), spans, listed


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_words, n_hit (words inside
    shared windows), n_items, items_sha256 (of the listed item_ids, sorted as
    strings and joined by commas), contaminated."""
    base, spans, listed = hits(docs, benchmark, **options)
    before = W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    covered = (spans.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
               .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).alias("n_hit")))
    names = (listed.groupBy("row").agg(
        F.count("*").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256")))
    return (base.join(covered, "row", "left").join(names, "row", "left")
            .select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit, whatever other rows have their id, or none."""
    # a hit is a matter of the text, so the id and a digest of the text tell which rows go
    digest = F.xxhash64(docs[text_col])
    marked = docs.select(F.struct(docs[id_col].alias("id"), digest.alias("digest")).alias("k"), docs[text_col].alias("text"))
    base, spans, _ = hits(marked, benchmark, id_col="k", **options)
    # a written list of ids: Spark broadcasts it if it is small, and joins it if not
    bad = staged(base.join(spans.select("row").distinct(), "row", "left_semi")
                 .select(F.col("doc_id.id").alias("bad_id"), F.col("doc_id.digest").alias("bad_digest")).distinct(), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad.bad_id) & (digest == bad.bad_digest), "left_anti")
