"""Mixing sources to target weights with a hypergeometric splitting tree.

Everything here is DataFrame work (no Python in tasks).

1. *Targets.*  The mix holds ``share`` times all words.  Sources share it by
   weight; a source's target stops at ``cap`` times its size, and the excess is
   reshared by weight until no target is above its cap (water-filling, solved in
   closed form over the sources ordered by cap per weight).
2. *Blocks and quotas.*  A block is ``block_words`` words of a document (the last
   one of a document may be shorter).  Each source's documents are put in
   a random order by a seeded hash, which numbers its blocks.  A source gives
   whole passes over its blocks and then the leading blocks of one more pass, as
   many as bring its words nearest to its target: an exact quota of blocks.
3. *Splitting tree.*  The quotas of all sources are split in two halves, these
   again, and so on to ``n_shards`` shards.  What each source gives to a left half
   is drawn from the multivariate hypergeometric law, as if the blocks
   of the node had been shuffled and cut in the middle: source by source from
   univariate draws, each a function of a hashed uniform number, at a cost that doesn't
   grow with the node.  Shards are equal in blocks to one, and quotas
   add up exactly.  The upper levels are one task's, the nodes of the lower ones are dealt to many.
4. *Draws.*  Consecutive runs of each source's permuted blocks go to the shards by
   these counts: no block goes twice in one pass.  In a shard the pieces are
   shuffled by a hash (``slot``).

The prefix sums that number the blocks go through hash buckets: sums of
(source, bucket), a running sum over the buckets of a source, and a
running sum inside a bucket.  No task holds a whole source.

Edge cases: a null or empty text has size 0, and nothing of it is taken; a null
source is a source of its own and the last one; a null doc_id is carried;
repeated rows are separate documents; an empty table gives no rows; extra
columns are ignored by ``mix`` and kept by ``mixed_documents``.
The result depends on the rows and the seed alone, not on their order or files.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termlink.llm.tables import staged

#: Levels of the splitting tree at which its nodes, two to the level, go to so many tasks.
_SPREAD = {8: 64, 16: 1024}
#: Hash buckets of a source, by which its blocks are numbered.
_BUCKET_BITS = 12
_NON_SPACE = r"[^\x20\x09-\x0D]+"


class Mix(NamedTuple):
    """documents: row, doc_id, source, size, source_size, target, hash (one per
    input row); parts: row, doc_id, hash, shard, slot, copy, first_word,
    end_word (what the mix takes); quotas: shard, rank, blocks."""

    documents: DataFrame
    parts: DataFrame
    quotas: DataFrame


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_NON_SPACE)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """``sources`` (rank, size, weight; one row per source) with their target."""
    by_room = W.orderBy(F.col("room") / F.col("weight"), "rank")
    full = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = (sources.withColumn("room", F.lit(float(cap)) * F.col("size"))
         .withColumn("total", F.lit(float(share)) * F.sum("size").over(full))
         .withColumn("below", F.coalesce(F.sum("room").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("weights", F.sum("weight").over(by_room.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("level", (F.col("total") - F.col("below")) / F.col("weights"))
         .withColumn("capped", F.col("level") * F.col("weight") > F.col("room"))
         .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(full)))
    return t.withColumn("target", F.when(F.col("capped"), F.col("room")).otherwise(
        F.least("room", F.col("level") * F.col("weight")))).drop("room", "total", "below", "weights", "level", "capped")


def _ln_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 7 (error below 1e-9)."""
    z = x + 7.0
    rising = reduce(lambda a, b: a * b, [x + float(i) for i in range(1, 7)])
    return ((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
            - F.log(rising))


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _ln_rise(x: Column, d: Column) -> Column:
    """ln (x + d)! - ln x!, from the difference of the series' terms, as both logarithms may be large."""
    z = x + 7.0
    rising = reduce(lambda a, b: a * b, [(x + d + float(i)) / (x + float(i)) for i in range(1, 7)])
    w = z + d
    return (d * F.log(z) + (w - 0.5) * F.log1p(d / z) - d + 1 / (12 * w) - 1 / (12 * z)
            - 1 / (360 * w * w * w) + 1 / (360 * z * z * z) - F.log(rising))


#: Of the ratio of uniforms: the bounding box of a unimodal law's region, 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
_BOX, _BOX_MORE = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
#: Tries of the sampler; each is taken with a chance of over a half.
_TRIES = 128


def hypergeometric(pop: Column, good: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among ``draws`` of ``pop`` without replacement, a function of the
    uniform number ``u``.

    Variances below 9 by inverting the distribution function at ``u``, where values
    more than nine standard deviations and nine off the mean (chance below 1e-18) are not
    reached.  Others by the ratio of uniforms, with a stream of numbers hashed from ``u``: about two tries, whatever the variance
    (the mode, if ``_TRIES`` all fail: a chance below 1e-38)."""

    def bounds(v: Column) -> Column:
        p, g, d = v["p"], v["g"], v["d"]
        mean = F.when(p > 0, d * g / p).otherwise(0.0)
        var = F.when(p > 1, mean * (1 - g / p) * (p - d) / (p - 1)).otherwise(0.0)
        reach = 9 * F.sqrt(F.greatest(F.least(var, F.lit(9.0)), F.lit(0.0))) + 9
        least, most = F.greatest(F.lit(0.0), d - (p - g)), F.least(d, g)
        tight = var < 9
        return F.struct(p.alias("p"), g.alias("g"), d.alias("d"), v["u"].alias("u"), mean.alias("mean"), var.alias("var"),
                        F.when(tight, F.greatest(least, F.floor(mean - reach).cast("double"))).otherwise(least).alias("low"),
                        F.when(tight, F.least(most, F.ceil(mean + reach).cast("double"))).otherwise(most).alias("high"))

    def inverted(v: Column) -> Column:
        p, g, d, low = v["p"], v["g"], v["d"], v["low"]

        def step(s: Column, j: Column) -> Column:
            x = j.cast("double")
            mass = s["mass"] * (g - x) * (d - x) / ((x + 1) * (p - g - d + x + 1))
            on = v["u"] > s["below"]
            return F.struct(F.when(on, j + 1).otherwise(s["x"]).alias("x"),
                            F.when(on, s["below"] + mass).otherwise(s["below"]).alias("below"), mass.alias("mass"))

        steps = F.when(v["high"] > low, F.sequence(low.cast("long"), v["high"].cast("long") - 1)).otherwise(
            F.array().cast("array<long>"))
        start = _let(F.exp(_ln_choose(g, low) + _ln_choose(p - g, d - low) - _ln_choose(p, d)), lambda m: F.struct(
            low.cast("long").alias("x"), m.alias("below"), m.alias("mass")))
        return F.aggregate(steps, start, step, lambda s: s["x"])

    def rejected(v: Column) -> Column:
        p, g, d = v["p"], v["g"], v["d"]
        box = _BOX * F.sqrt(v["var"] + 0.5) + _BOX_MORE
        mode = F.floor((d + 1) * (g + 1) / (p + 2)).cast("double")

        def attempt(s: Column, t: Column) -> Column:
            x = F.greatest(_uniform(v["u"], t, F.lit(1)), F.lit(2.0 ** -53))
            z = F.floor(v["mean"] + 0.5 + s["box"] * (_uniform(v["u"], t, F.lit(2)) - 0.5) / x).cast("double")

            def judged(w: Column) -> Column:
                off, m = w["z"] - s["mode"], s["mode"]
                # the law at z over the law at the mode
                ratio = -(_ln_rise(m, off) + _ln_rise(g - m, -off) + _ln_rise(d - m, -off) + _ln_rise(p - g - d + m, off))
                inside = (w["z"] >= v["low"]) & (w["z"] <= v["high"])
                taken = F.when(inside, 2 * F.log(w["x"]) <= ratio).otherwise(False)
                return F.struct(F.when(taken, w["z"]).otherwise(s["x"]).alias("x"), taken.alias("done"), s["mode"].alias("mode"),
                                s["box"].alias("box"))
            return F.when(s["done"], s).otherwise(_let(F.struct(x.alias("x"), z.alias("z")), judged))

        start = F.struct(mode.alias("x"), F.lit(False).alias("done"), mode.alias("mode"), box.alias("box"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(_TRIES - 1)), start, attempt, lambda s: s["x"].cast("long"))

    def draw(v: Column) -> Column:
        return F.when(v["var"] < 9, inverted(v)).otherwise(rejected(v))

    numbers = F.struct(pop.cast("double").alias("p"), good.cast("double").alias("g"),
                       draws.cast("double").alias("d"), u.alias("u"))
    return _let(_let(numbers, bounds), draw)


def _uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0 ** -53)


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``quotas`` (rank, blocks) among ``n_shards`` (a power of two) shards: one
    row ``shard, rank, blocks`` per shard and source.  The node's counts are an
    array by source, so a node's work is one row's, and rows double by level; they
    are dealt to tasks anew at the levels of ``_SPREAD``."""
    if n_shards < 1 or n_shards & (n_shards - 1):
        raise ValueError("n_shards must be a power of two")
    nodes = (quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "blocks"))).alias("of"))
             .select(F.lit(0).cast("long").alias("shard"), "of"))
    for level in range(n_shards.bit_length() - 1):
        if level in _SPREAD:
            nodes = nodes.repartition(_SPREAD[level], "shard")
        total = F.aggregate("of", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
        start = F.struct(total.alias("pop"), F.floor(total / 2).cast("long").alias("draws"),
                         F.array().cast("array<long>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            # pop: blocks of this source and later ones; draws: still due before the last source's
            due = s["draws"] - F.when(F.size(s["out"]) > 0, F.element_at(s["out"], -1)).otherwise(0)
            u = _uniform(F.lit(seed), F.lit(level), F.col("shard"), x["rank"])  # noqa: B023 (used in this turn only)
            got = hypergeometric(s["pop"], x["blocks"], due, u)
            return F.struct((s["pop"] - x["blocks"]).alias("pop"), due.alias("draws"),
                            F.concat(s["out"], F.array(got)).alias("out"))

        nodes = (nodes.withColumn("left", F.aggregate("of", start, step, lambda s: s["out"]))
                 .withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
                 .select((F.col("shard") * 2 + F.col("side")).alias("shard"),
                         F.zip_with("of", "left", lambda x, y: F.struct(
                             x["rank"].alias("rank"),
                             F.when(F.col("side") == 0, y).otherwise(x["blocks"] - y).alias("blocks"))).alias("of")))
    return nodes.select("shard", F.explode("of").alias("x")).select("shard", "x.rank", "x.blocks")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0,
        n_shards: int | None = None, shard_words: int = 1 << 22, block_words: int = 64, whole_documents: bool = False, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Mix ``docs`` (see the module's text).  The sources in order of code points,
    null last, have ``weights`` in turn.  n_shards: a power of two; if None, the least
    that keeps shards to about ``shard_words`` words.  whole_documents: a document copy
    that spans shards goes to the one it begins in as a whole, and a pass takes
    whole documents (the nearest cut), at the price of exact block counts."""
    d = staged(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), source_col), F.lit("")).alias("key"), n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), *docs.columns).alias("hash")), "mix-documents")
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    blocks = F.ceil(F.col("size") / block_words).cast("long")
    sources = (d.groupBy("key", "source").agg(F.sum("size").alias("size"), F.sum(blocks).alias("pass_blocks"))
               .withColumn("rank", nth)
               .withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("rank") % len(weights) + 1)))
    sources = staged(
        targets(sources, share, cap)
        .withColumn("passes", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("size"))
        .withColumnRenamed("size", "source_size"), "mix-sources")

    placed = d.join(sources.select("key", "rank", "source_size", "target", "pass_blocks", "passes", "rest"), "key")
    placed = (placed.withColumn("blocks", blocks)
              .withColumn("bucket", F.shiftrightunsigned("hash", 64 - _BUCKET_BITS)))
    earlier = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = (placed.groupBy("rank", "bucket").agg(F.sum("blocks").alias("b"), F.sum("size").alias("w"))
               .select("rank", "bucket", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"),
                       F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0")))
    inside = W.partitionBy("rank", "bucket").orderBy("hash", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    rest = F.col("rest") - F.col("first_word")          # words of the last pass left for this document and later ones
    more = F.round(rest / block_words).cast("long")
    if whole_documents:
        more = F.when(rest >= F.col("size") / 2, F.col("blocks")).otherwise(0)
    placed = staged(
        placed.join(buckets, ["rank", "bucket"])
        .withColumn("first_block", F.col("b0") + F.coalesce(F.sum("blocks").over(inside), F.lit(0)))
        .withColumn("first_word", F.col("w0") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("extra", F.when(rest >= F.col("size"), F.col("blocks"))
                    .otherwise(F.least("blocks", F.greatest(more, F.lit(0)))).cast("long"))
        .drop("bucket", "b0", "w0", "first_word", "rest"), "mix-order")

    totals = (placed.groupBy("rank").agg((F.first("passes") * F.first("pass_blocks") + F.sum("extra")).alias("blocks")))
    if n_shards is None:
        words = block_words * (totals.agg(F.sum("blocks")).first()[0] or 0)
        n_shards = 1 << max(0, -(-words // shard_words) - 1).bit_length()
    quotas = staged(split_quotas(totals, n_shards, seed), "mix-quotas")
    by_shard = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    runs = (quotas.where("blocks > 0").join(totals.withColumnRenamed("blocks", "quota"), "rank")
            .withColumn("run0", F.coalesce(F.sum("blocks").over(by_shard), F.lit(0)))
            .withColumn("run1", F.col("run0") + F.col("blocks")).withColumn("bin", F.ceil(F.col("quota") / n_shards)))

    # every copy of a document is a run of its source's drawn blocks; runs of copies
    # and of shards meet in bins of about a shard's share
    copies = (placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
              .withColumn("taken", F.when(F.col("copy") < F.col("passes"), F.col("blocks")).otherwise(F.col("extra")))
              .where("taken > 0")
              .withColumn("c0", F.col("copy") * F.col("pass_blocks") + F.col("first_block"))
              .withColumn("c1", F.col("c0") + F.col("taken"))
              .select("row", "doc_id", "hash", "rank", "size", "copy", "c0", "c1")
              .join(totals.select("rank", F.ceil(F.col("blocks") / n_shards).alias("bin")), "rank"))
    last = F.col("c0") if whole_documents else F.col("c1") - 1
    copies = copies.withColumn("at", F.explode(F.sequence(
        F.floor(F.col("c0") / F.col("bin")), F.floor(last / F.col("bin")))))
    runs = runs.withColumn("at", F.explode(F.sequence(
        F.floor(F.col("run0") / F.col("bin")), F.floor((F.col("run1") - 1) / F.col("bin"))))).drop("bin", "blocks", "quota")
    p0 = F.greatest("c0", "run0", F.col("at") * F.col("bin"))
    p1 = F.least("c1", "run1", (F.col("at") + 1) * F.col("bin"))
    met = copies.join(runs, ["rank", "at"])
    if whole_documents:
        met = met.where((F.col("run0") <= F.col("c0")) & (F.col("c0") < F.col("run1"))).withColumns(
            {"p0": F.col("c0"), "p1": F.col("c1")})
    else:
        met = (met.where(p0 < p1).groupBy("row", "doc_id", "hash", "rank", "size", "copy", "c0", "shard")
               .agg(F.min(p0).alias("p0"), F.max(p1).alias("p1")))
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "hash", "copy", "p0"), "row", "copy", "p0")
    parts = met.select(
        "row", "doc_id", "hash", "shard", F.row_number().over(order).alias("slot"), "copy",
        ((F.col("p0") - F.col("c0")) * block_words).alias("first_word"),
        F.least(F.col("size"), (F.col("p1") - F.col("c0")) * block_words).alias("end_word"))
    documents = d.join(sources.select("key", "source_size", "target"), "key").select(
        "row", "doc_id", "source", "size", "source_size", "target", "hash")
    return Mix(documents, parts, quotas)


def taken(m: Mix) -> DataFrame:
    """The documents with ``taken``, the words the mix takes of each, and ``n_parts``."""
    got = m.parts.groupBy("row").agg(F.sum(F.col("end_word") - F.col("first_word")).alias("words"), F.count("*").alias("n"))
    return m.documents.join(got, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_parts"))


def mixed_documents(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the columns of ``docs`` and, last, a struct ``drawn`` (with
    underscores after it until no column has its name) of shard, slot, copy, first_word, end_word;
    the text is cut to its words [first_word, end_word) with their white space.
    Partitioned by shard and sorted by slot."""
    drawn = "drawn"
    while drawn in docs.columns:
        drawn += "_"
    m = mix(docs, seed=seed, id_col=id_col, text_col=text_col, **options)
    parts = m.parts.select(F.struct("doc_id", "hash", "shard", "slot", "copy", "first_word", "end_word").alias(drawn))
    hashed = F.xxhash64(F.lit(seed), *[docs[c] for c in docs.columns])

    def same(df: DataFrame) -> Column:
        return docs[id_col].eqNullSafe(df[drawn]["doc_id"]) & (hashed == df[drawn]["hash"])

    own = docs
    twice = staged(m.documents.groupBy("doc_id", "hash").count().where("count > 1").select(
        F.struct("doc_id", "hash").alias(drawn)), "mix-repeated")
    if not twice.isEmpty():
        # the parts of equal rows find one of them
        own = docs.join(twice, same(twice), "left_anti").unionByName(docs.join(twice, same(twice), "left_semi").dropDuplicates())
        hashed = F.xxhash64(F.lit(seed), *[own[c] for c in docs.columns])
        met = own.join(parts, own[id_col].eqNullSafe(parts[drawn]["doc_id"]) & (hashed == parts[drawn]["hash"]))
    else:
        met = docs.join(parts, same(parts))
    part = F.col(drawn)
    words = F.regexp_extract_all(text_col, F.lit(rf"[\x20\x09-\x0D]*{_NON_SPACE}"), F.lit(0))
    cut = F.when((part["first_word"] == 0) & (part["end_word"] >= n_words(F.col(text_col))), F.col(text_col)).otherwise(
        F.array_join(F.slice(words, (part["first_word"] + 1).cast("int"),
                             (part["end_word"] - part["first_word"]).cast("int")), ""))
    return (met.withColumn(text_col, cut)
            .withColumn(drawn, F.struct(*[part[c].alias(c) for c in ("shard", "slot", "copy", "first_word", "end_word")]))
            .repartition(part["shard"]).sortWithinPartitions(part["shard"], part["slot"]))
