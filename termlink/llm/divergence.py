"""How far the word use of each source departs from its language and from its peers.

Terms are runs of letters (ASCII letters in lower case, and all non-ASCII characters).
A language keeps the terms that at least ``min_docs`` of its documents hold.  Every
(language, source) group and every language gives each kept term a smoothed share
``p = 1 + floor(10**9 (count + 1) / (total + V))``; a share's divergence from another
is ``f(p, q) = floor((p - q)**2 / q)``, in whole numbers throughout.

``audit`` sums f over all kept terms for each ordered pair of a language's
sources, by Gustavson's row-wise sparse product: the counts lie in a term-major index
(a term's row lists the groups that have it), slices of whole rows are dealt to tasks, and
in a slice each group looks up its terms' rows and scatters them into one dense
accumulator over its peers.  So a slice gives one number for a pair of groups, however many terms
they share, and no pair of postings is ever emitted.

Terms that only one of two groups has, or none, aren't met that way.  With z the share of an
absent term, the sum over all V kept terms is

    V f(z_s, z_t) + sum over s's terms (f(p_s, z_t) - f(z_s, z_t))
                  + sum over t's terms (f(z_s, p_t) - f(z_s, z_t))
                  + sum over common terms (f(p_s, p_t) - f(p_s, z_t) - f(z_s, p_t) + f(z_s, z_t)),

where only the last line needs the index.  The others depend on a term's count alone, so they come
from each group's histogram of counts (at most the root of twice its words), in blocks against blocks
of peers.

Limits: sums fit 64 bits up to 10**9 kept terms a language, shares up to 9 * 10**15 words
a group.  The result has a row for every pair of sources of a language by definition.

Edge cases: null text, language or source count as ''; a group without terms has all peers and
no term rows; a language without kept terms has the value 0 for all pairs; ties are ranked by item in UTF-8
order; repeated rows are documents of their own; very long texts are counted a few megabytes at a
time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termlink.llm.tables import small_text_batches, staged

#: All bytes of a non-ASCII character are >= 0x80, and ``bytes.lower`` changes A-Z only.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
_PIECE = 1 << 22
#: Distinct terms of a task's counters before they are emitted and emptied.
_HELD = 200_000
_SALTS = 16
#: Counts in a block of a histogram, sources in a block of peers.
_COUNTS, _PEERS = 1 << 16, 1 << 13
#: Postings that are scattered at once.
_SCATTER = 1 << 20


def pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` in parts of about ``_PIECE`` bytes, cut between terms."""
    at = 0
    while len(raw) - at > _PIECE:
        gap = _GAP.search(raw, at + _PIECE)
        end = gap.start() if gap else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()),
                 pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for b in batches:
        texts = b.column(2).cast(pa.binary())
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for part in pieces(text.as_py()):
                found = _TERM.findall(part.lower())
                n.update(found)
                own.update(found)
            docs.update(own)
            size += len(n) - before
            if size >= _HELD:
                yield from emit()
                size = 0
    yield from emit()


def term_index(docs: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term, source, n, lang_n, first`` of the kept terms, written term by term: n occurrences
    in the group, lang_n in the language, first marks one row of each term."""
    small_text_batches(docs.sparkSession)
    w = W.partitionBy("lang", "term")
    # counted in the tasks already; one shuffle serves the sum, the windows and the written order
    return staged(
        docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        .repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("in_docs", F.sum("docs").over(w)).withColumn("lang_n", F.sum("n").over(w))
        .withColumn("first", (F.row_number().over(w.orderBy("source")) == 1).cast("int"))
        .where(F.col("in_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n", "first"), "term-index")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total), for 0 <= count <= total: a long division by thousands,
    as the product may not fit 64 bits."""
    total = np.maximum(total, 1)
    out, rest = np.zeros_like(total), count + np.zeros_like(total)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_OUT = "lang string, source string, part string, item string, value long"


def _rows(lang: str, source: list | str, part: str, item: list[str], value: np.ndarray) -> pa.RecordBatch:
    source = [source] * len(item) if isinstance(source, str) else source
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(item), pa.string()), pa.array(source, pa.string()), pa.array([part] * len(item), pa.string()),
         pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo[i] .. lo[i] + n[i] - 1, for one i after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(lo - ends + n, n)


def row_products(group: np.ndarray, p: np.ndarray, absent: np.ndarray, ptr: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each group g the dense vector over its peers of the corrections of their common terms.

    The index's postings: ``group`` and share ``p``, the k-th term's from ptr[k] to ptr[k + 1];
    ``absent``: each group's share of an absent term."""
    term = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(len(absent) + 1))
    for g in range(len(absent)):
        mine = order[bounds[g]: bounds[g + 1]]
        lo, n = ptr[term[mine]], np.diff(ptr)[term[mine]]
        row = np.zeros(len(absent), np.int64)
        cuts = np.unique(np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), _SCATTER)))
        for a, b in zip(cuts, [*cuts[1:], len(mine)]):
            at = _spread(lo[a:b], n[a:b])
            peer, own = group[at], np.repeat(p[mine[a:b]], n[a:b])
            np.add.at(row, peer, divergence(own, p[at]) - divergence(own, absent[peer])
                      - divergence(absent[g], p[at]) + divergence(absent[g], absent[peer]))
        row[g] = 0
        yield g, row


def _accumulate(top: int, slice_rows: int):
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of whole terms."""
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < slice_rows:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = (t["lang"][-1], t["term"][-1])
            cut = t.num_rows - 1
            while cut and (t["lang"][cut - 1], t["term"][cut - 1]) == last:
                cut -= 1
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
                n = t.num_rows - cut
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches):
            for lang in whole["lang"].unique().to_pylist():
                t = whole.filter(pc.equal(whole["lang"], lang)).combine_chunks()
                n, lang_n, total, kinds, lang_total = (t[c].to_numpy() for c in ("n", "lang_n", "total", "kept", "lang_total"))
                names = t["source"].unique()
                group = pc.index_in(t["source"], names).to_numpy().astype(np.int64)
                names = names.to_pylist()
                p, q = share(n + 1, total + kinds), share(lang_n + 1, lang_total + kinds)
                absent = np.zeros(len(names), np.int64)
                absent[group] = share(np.ones_like(n), total + kinds)
                terms = pc.run_end_encode(t["term"].combine_chunks())
                ptr = np.concatenate([[0], terms.run_ends.to_numpy().astype(np.int64)])
                for g, row in row_products(group, p, absent, ptr):
                    met = np.flatnonzero(row)
                    yield _rows(lang, names[g], "pair", [names[i] for i in met], row[met])
                high = np.flatnonzero(p > q)
                value = divergence(p[high], q[high])
                # rows come in the order of terms, and the sort keeps it
                order = high[np.lexsort((-value, group[high]))]
                first = np.searchsorted(group[order], group[order])
                best = order[np.arange(len(order)) - first < top]
                yield _rows(lang, [names[i] for i in group[best]], "term", t["term"].take(pa.array(best)).to_pylist(),
                            divergence(p[best], q[best]))
    return run


def _baseline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            names = [x["source"] for x in r["peers"]]
            absent = share(np.int64(1), np.array([x["total"] for x in r["peers"]], np.int64) + r["kept"])
            own = share(np.int64(1), np.array([r["total"] + r["kept"]]))[0]
            if r["counts"] is None:
                yield _rows(r["lang"], r["source"], "pair", names, r["kept"] * divergence(own, absent))
                continue
            times = np.array([x["times"] for x in r["counts"]], np.int64)
            p = share(np.array([x["n"] for x in r["counts"]], np.int64) + 1, np.full(len(times), r["total"] + r["kept"]))
            to, back = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
            for i, z in enumerate(absent):
                to[i] = (times * (divergence(p, z) - divergence(own, z))).sum()
                back[i] = (times * (divergence(z, p) - divergence(z, own))).sum()
            yield _rows(r["lang"], r["source"], "pair", names, to)
            yield _rows(r["lang"], names, "pair", [r["source"]] * len(names), back)


def baselines(index: DataFrame, groups: DataFrame) -> DataFrame:
    """The terms of the sum that don't need the index, in parts to be summed."""
    blocks = F.ceil(F.least(F.col("kinds"), F.sqrt(2 * F.col("total"))) / _COUNTS)
    counts = (index.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups, ["lang", "source"])
              .withColumn("block", F.pmod(F.xxhash64("n"), blocks.cast("long")))
              .groupBy("lang", "source", "total", "kept", "block").agg(F.collect_list(F.struct("n", "times")).alias("counts")))
    whole = groups.select("lang", "source", "total", "kept", F.lit(-1).cast("long").alias("block"))
    left = counts.unionByName(whole, allowMissingColumns=True).withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(_SALTS)))
    peers = (groups.join(groups.groupBy("lang").agg(F.ceil(F.count("*") / _PEERS).alias("blocks")), "lang")
             .groupBy("lang", F.pmod(F.xxhash64("source"), F.col("blocks")).alias("peer_block"))
             .agg(F.collect_list(F.struct("source", "total")).alias("peers"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))))
    return (left.join(peers, ["lang", "salt"]).repartition("lang", "source", "block", "peer_block")
            .select("lang", "source", "total", "kept", "counts", "peers").mapInArrow(_baseline, _OUT))


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", slice_rows: int = 1 << 18) -> DataFrame:
    """``lang, source, part, item, value, rank``: part 'pair' ranks all other sources of the
    language by their divergence from the group, part 'term' the ``top`` terms that the group uses
    more than its language does.  ``slice_rows`` postings of the index are held at a time; without
    influence on results."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
            for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = docs.select(*text)
    index = term_index(docs, min_docs)
    of_group = index.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    of_lang = index.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("lang_total"))
    groups = staged(docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left")
                    .join(of_lang, "lang", "left").na.fill(0), "term-groups")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    parts = staged(
        index.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(_SALTS))).join(salted, ["lang", "source", "salt"])
        .select("lang", "term", "source", "n", "lang_n", "total", "kept", "lang_total")
        .repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
        .mapInArrow(_accumulate(top, slice_rows), _OUT), "divergence-parts")
    pairs = (baselines(index, groups).unionByName(parts.where("part = 'pair'")).where("source <> item")
             .groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
