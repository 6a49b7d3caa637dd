import math
import re
from collections import Counter, defaultdict

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from termlink.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, share=1.5, cap=2.0):
    """Reshare by weight until no source is above its cap."""
    total, fixed = share * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = total - sum(fixed.values())
        over = [i for i in free if rest * weights[i] / sum(weights[j] for j in free) > cap * sizes[i]]
        if not over:
            return [fixed.get(i, rest * weights[i] / sum(weights[j] for j in free) if free else 0) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def test_targets_and_what_is_taken(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = docs.collect()
    got = mixing.taken(mixing.mix(docs, n_shards=8)).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows})
    by_source = [sum(size[r.doc_id] for r in rows if r.source == s) for s in sources]
    target = dict(zip(sources, plain_targets(by_source, [(5, 2, 1)[i % 3] for i in range(len(sources))])))
    took = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[r.source])
        took[r.source] += r.taken
    for s in sources:
        assert abs(took[s] - target[s]) <= 32.5
    again = mixing.taken(mixing.mix(docs.repartition(5), n_shards=8))
    assert sorted(again.collect()) == sorted(got)


@pytest.mark.parametrize("pop, good, draws", [(50, 20, 25), (7, 7, 3), (9, 0, 4), (1, 1, 0), (40, 39, 20)])
def test_hypergeometric_law(spark, pop, good, draws):
    n = 400
    u = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u"))
    x = u.select(mixing.hypergeometric(F.lit(pop), F.lit(good), F.lit(draws), F.col("u")).alias("x"))
    share = {r.x: r["count"] / n for r in x.groupBy("x").count().collect()}
    for k in range(max(0, draws - pop + good), min(good, draws) + 1):
        law = math.comb(good, k) * math.comb(pop - good, draws - k) / math.comb(pop, draws)
        assert share.get(k, 0) == pytest.approx(law, abs=2 / n)


def ln_law(pop, good, draws, k):
    def ln_choose(n, r):
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    return ln_choose(good, k) + ln_choose(pop - good, draws - k) - ln_choose(pop, draws)


@pytest.mark.parametrize("pop, good, draws", [(400, 150, 180), (1000, 900, 500), (5000, 60, 2500), (200_000, 100_000, 100_000),
                                              (10 ** 6, 400, 500_000)])
def test_law_of_larger_populations(spark, pop, good, draws):
    """The chi-square of the counts in fifty or so bins against the law itself."""
    n = 20_000
    u = spark.range(n).select(mixing._uniform(F.lit(7), F.col("id")).alias("u"))
    count = Counter({r.x: r["count"] for r in u.select(
        mixing.hypergeometric(F.lit(pop), F.lit(good), F.lit(draws), F.col("u")).alias("x")).groupBy("x").count().collect()})
    mean = draws * good / pop
    sd = (mean * (1 - good / pop) * (pop - draws) / (pop - 1)) ** 0.5
    assert min(count) >= max(0, draws - pop + good) and max(count) <= min(good, draws)
    low, high = max(0, draws - pop + good, int(mean - 12 * sd)), min(good, draws, int(mean + 12 * sd))
    chi, bins, want, got = 0.0, 0, 0.0, 0
    for k in range(low, high + 1):
        want += n * math.exp(ln_law(pop, good, draws, k))
        got += count[k]
        if want >= n / 60:
            chi, bins, want, got = chi + (got - want) ** 2 / want, bins + 1, 0.0, 0
    assert bins > 5 and chi < bins + 5 * (2 * bins) ** 0.5


@pytest.mark.parametrize("pop", [10 ** 9, 10 ** 12, 3 * 10 ** 14])
def test_moments_and_quantiles_of_very_large_populations(spark, pop):
    n, good, draws = 20_000, pop // 3, pop // 2
    u = spark.range(n).select(mixing._uniform(F.lit(9), F.col("id")).alias("u"))
    x = sorted(r.x for r in u.select(mixing.hypergeometric(F.lit(pop), F.lit(good), F.lit(draws), F.col("u")).alias("x")).collect())
    mean = draws * good / pop
    sd = (mean * (1 - good / pop) * (pop - draws) / (pop - 1)) ** 0.5
    z = [(v - mean) / sd for v in x]
    assert abs(sum(z) / n) < 5 / n ** 0.5 and abs(sum(v * v for v in z) / n - 1) < 5 * (2 / n) ** 0.5
    for share, quantile in ((0.02275, -2), (0.15866, -1), (0.5, 0), (0.84134, 1), (0.97725, 2)):
        assert abs(sum(v < quantile for v in z) / n - share) < 5 * (share * (1 - share) / n) ** 0.5


def test_many_shards_come_from_many_tasks(spark):
    quotas = spark.createDataFrame([(0, 400_000_000), (1, 300_000_000), (2, 3_000_000), (3, 0), (4, 297_000_001)], "rank int, blocks long")
    rows = mixing.split_quotas(quotas, 1 << 12, 3).withColumn("task", F.spark_partition_id())
    s = rows.groupBy("shard").agg(F.sum("blocks").alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert s[1] - s[0] <= 1 and s[2] == 1 << 12
    assert {r["rank"]: r.n for r in rows.groupBy("rank").agg(F.sum("blocks").alias("n")).collect()} == {r["rank"]: r.blocks for r in quotas.collect()}
    assert rows.select("task").distinct().count() > 30


def test_tree_keeps_quotas_and_shards_equal(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 37), (2, 0), (3, 5)], "rank int, blocks long")
    rows = mixing.split_quotas(quotas, 16, 3).collect()
    of, shard = Counter(), Counter()
    for r in rows:
        assert r.blocks >= 0
        of[r["rank"]] += r.blocks
        shard[r.shard] += r.blocks
    assert dict(of) == {0: 1000, 1: 37, 2: 0, 3: 5}
    assert set(shard.values()) <= {65, 66}
    with pytest.raises(ValueError):
        mixing.split_quotas(quotas, 6, 3)


def test_draws_are_disjoint_and_fill_the_quotas(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    m = mixing.mix(docs, n_shards=8, block_words=16)
    quota = Counter()
    for r in m.quotas.collect():
        quota[r.shard] += r.blocks
    held, spans = Counter(), defaultdict(list)
    for r in m.parts.collect():
        held[r.shard] += -(-(r.end_word - r.first_word) // 16)
        spans[r.row, r["copy"]].append((r.first_word, r.end_word))
    assert held == +quota
    for parts in spans.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    slots = m.parts.groupBy("shard").agg(F.max("slot").alias("top"), F.countDistinct("slot").alias("n"), F.count("*").alias("rows"))
    assert all(r.top == r.n == r.rows for r in slots.collect())


def test_texts_of_the_mix(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = mixing.mixed_documents(docs, n_shards=4).collect()
    whole = {r.doc_id: WORD.findall(r.text) for r in docs.collect()}
    for r in rows:
        assert WORD.findall(r.text) == whole[r.doc_id][r.drawn.first_word: r.drawn.end_word]
    kept = mixing.mixed_documents(docs, n_shards=4, whole_documents=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] for r in kept)


def test_odd_rows(spark):
    rows = [(1, "a b c", None), (2, None, "s"), (3, "", "s"), (None, "d e", "s"), (1, "a b c", None), (1, "a b c", None),
            (5, " ".join("w" * 1 for _ in range(5000)), "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {c: F.lit("clash") for c in ("size", "shard", "copy", "rank")})
    got = mixing.taken(mixing.mix(docs, n_shards=4)).collect()
    assert len(got) == 7
    assert sum(r.taken for r in got if r.size == 0) == 0
    assert [r.source_size for r in got if r.source is None] == [9] * 3
    assert all(r.taken <= 2 * r.size for r in got)
    mixed = mixing.mixed_documents(docs, n_shards=4)
    assert mixed.columns == [*docs.columns, "drawn"]
    words = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert words == sum(r.taken for r in got)
    clash = mixing.mixed_documents(docs.withColumn("drawn", F.lit(1)), n_shards=4)
    assert clash.columns == [*docs.columns, "drawn", "drawn_"] and clash.count() > 0
    empty = docs.limit(0)
    assert mixing.taken(mixing.mix(empty, n_shards=4)).count() == 0
    assert mixing.mixed_documents(empty, n_shards=4).count() == 0
