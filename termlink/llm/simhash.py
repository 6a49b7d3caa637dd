"""SimHash near-duplicates: fingerprints, links within a few bits, classes.

Method: pigeonhole blocks.  The 64 bits are cut into ``blocks`` runs; two
fingerprints that differ in at most d bits agree in at least ``blocks - d``
runs, so every choice of ``blocks - d`` runs is a join key and close pairs share
one.  Joined pairs are verified by their Hamming distance.

Only distinct fingerprints are joined; copies cost one row.  A key that more
than ``crowd`` distinct fingerprints share isn't paired up.  Its members agree
in the key's runs, so all their differences lie in the other bits, and two of
them are within d bits exactly if some value lies within d/2 (rounded up and
down) bits of both: each member is listed under all such values and
linked to the smallest member listed there.  That is exact for components, and its
rows grow with the members, not with their pairs.

Edge cases: a null text is an empty one; texts without words have fingerprint
0 and link like any other; a null doc_id never is a component's id unless all
its members' are null; repeated rows are returned as often as they occur;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlink.llm.components import components
from termlink.llm.tables import small_text_batches, staged

#: Shingles hashed at once: bounds memory, whatever a text's length.
_CHUNK = 1 << 16


def fingerprint_of(text: bytes, shingle: int, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half the shingles' XXH64 values."""
    words = text.lower().split()      # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    ends = ends[shingle - 1:]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), _CHUNK):
        a, b = starts[i: i + _CHUNK].tolist(), ends[i: i + _CHUNK].tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(joined[x:y], seed) for x, y in zip(a, b)), "<u8", len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(starts)).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``doc_id, digest, fp`` (64 bits in a signed long) per row of ``docs``; digest is a hash of the text."""
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(1), "").cast(pa.binary())
            fp = np.array([fingerprint_of(x.as_py(), shingle, seed) for x in text], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "digest", "fp"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _digest(docs[text_col]).alias("digest"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, digest long, fp long")


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _runs(blocks: int) -> list[int]:
    """Bit masks of the runs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, max_bits: int = 2, blocks: int = 5, crowd: int = 64) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column fp, distinct), such
    that their components are those of all pairs within ``max_bits`` bits."""
    if not 0 < max_bits < blocks:
        raise ValueError("need 0 < max_bits < blocks")
    runs = _runs(blocks)
    masks = [sum(c) for c in combinations(runs, blocks - max_bits)]
    keyed = fps.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("part", "key"))
    sizes = keyed.groupBy("part", "key").count().where("count > 1")
    shared = keyed.join(sizes, ["part", "key"])

    few = shared.where(F.col("count") <= crowd)
    pairs = (few.select("part", "key", F.col("fp").alias("a"))
             .join(few.select("part", "key", F.col("fp").alias("b")), ["part", "key"])
             .where(F.col("a") < F.col("b"))
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
             .select("a", "b"))

    # within a key, differences lie in the free bits: values within half the
    # distance of each member
    near, far = max_bits // 2, max_bits - max_bits // 2
    flips = []
    for m in masks:
        free = [1 << i for i in range(64) if not m >> i & 1]
        flips.append({r: [_signed(sum(c)) for n in range(r + 1) for c in combinations(free, n)] for r in (near, far)})
    crowded = shared.where(F.col("count") > crowd).select("part", "key", "fp")

    def listed(radius: int) -> DataFrame:
        table = F.element_at(F.array(*[F.array(*map(F.lit, f[radius])) for f in flips]), F.col("part") + 1)
        return (crowded.withColumn("flip", F.explode(table))
                .select("part", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "fp"))

    low = listed(near).groupBy("part", "key", "value").agg(F.min("fp").alias("b"))
    wide = listed(far)
    met = wide.join(low, ["part", "key", "value"])
    return pairs.unionByName(met.select(F.col("fp").alias("a"), "b")).where("a != b").distinct()


def _members(docs: DataFrame, shingle: int = 3, max_bits: int = 2, blocks: int = 5, crowd: int = 64, seed: int = 42,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``doc_id, digest, fp, root, component_id`` per row of ``docs``; root is the class."""
    fps = staged(fingerprints(docs, shingle, seed, id_col, text_col), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(links(classes.select("fp"), max_bits, blocks, crowd))
    rooted = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    member = rooted.join(ids, "root").select("fp", "root", "component_id")
    return fps.join(member, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, blocks: int = 5,
                    crowd: int = 64, seed: int = 42, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row ``doc_id, fp, component_id`` per row of ``docs``; component_id is
    the smallest doc_id reachable over links of at most ``max_bits`` bits."""
    return _members(docs, shingle, max_bits, blocks, crowd, seed, id_col, text_col).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class: its smallest doc_id's (of several texts of the class under that id, the
    one of the smallest digest).  Rows whose whole class has null ids all stay.  An id whose texts are in several
    classes is judged in each by itself."""
    found = staged(_members(docs, id_col=id_col, text_col=text_col, **options), "classes")
    low = found.where("doc_id = component_id")
    several = low.groupBy("root").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first != last")
    # written lists of ids and digests: Spark broadcasts them if they are small, and joins them if not
    others = found.where("component_id is not null and (doc_id is null or doc_id != component_id)").select("doc_id", "digest")
    later = low.select("root", "doc_id", "digest").distinct().join(several, "root").where("digest != first").select("doc_id", "digest")
    gone = staged(others.unionByName(later).distinct(), "copies")
    twice = staged(low.groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest"), "repeated")

    def match(left: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias("listed_id"), F.col("digest").alias("listed_digest"))
        return left.join(ids, left[id_col].eqNullSafe(ids.listed_id) & (_digest(left[text_col]) == ids.listed_digest), how)

    kept = match(docs, gone, "left_anti")
    if twice.isEmpty():
        return kept
    again = match(kept, twice, "left_semi").withColumn("__digest", _digest(F.col(text_col)))
    return match(kept, twice, "left_anti").unionByName(again.dropDuplicates([id_col, "__digest"]).drop("__digest"))
