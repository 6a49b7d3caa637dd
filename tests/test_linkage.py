"""Pruned linkage joins against brute force computed in plain Python."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from termlink.functions.jaro import jaro_winkler_distance
from termlink.operators.jaccard import link_weighted_jaccard
from termlink.operators.linkage import jw_bounds, jw_scored, link_exact, link_fuzzy_jw, winkler_distance
from termlink.plans import registry as R


def brute_jw(left: pd.DataFrame, right: pd.DataFrame, col, p, maxd):
    """All pairs, without any bound."""
    pairs = [(lk, l, rk, r) for lk, l in zip(left.study_name_rare, left[col]) for rk, r in zip(right.study_name_common, right[col])]
    best = {}
    for d, (lk, _, rk, _) in zip(jaro_winkler_distance([x[1] for x in pairs], [x[3] for x in pairs], p), pairs):
        if d <= maxd:
            best[lk] = min(best.get(lk, (2.0, "")), (d, rk))
    return best


@pytest.mark.parametrize("col,p", [("trait", 0.1), ("trait2", 0.1), ("trait2", 0.15)])
def test_fuzzy_jw_equals_bruteforce(spark, col, p):
    """All pairs of the longest, the shortest and some other sentences, in all languages."""
    left = R._with_trait2(R._rare_left(spark, SF_SMALL)).toPandas()
    right = R._with_trait2(R._common_right(spark, SF_SMALL)).toPandas()
    left, right = (pd.concat([d.iloc[d.trait.str.len().argsort().iloc[list(range(40)) + list(range(-25, 0))]], d.sample(90, random_state=1)])
                   .drop_duplicates() for d in (left, right))
    l, r = spark.createDataFrame(left), spark.createDataFrame(right)
    got = link_fuzzy_jw(l, r, col, "study_name_rare", "study_name_common",
                        ("_rare", "_common"), p=p, keep_dist=True).toPandas()
    exp = brute_jw(left, right, col, p, 0.05)
    got_map = {r.study_name_rare: (r.dist, r.study_name_common) for r in got.itertuples()}
    assert got_map == exp


@pytest.mark.parametrize("p, half", [(0.1, True), (0.15, True), (0.2, False), (0.0, True)])
def test_scored_pairs_are_lossless_on_random_unicode(spark, p, half):
    rng = random.Random(int(100 * p))
    texts = set()
    for n in (1, 2, 3, 5, 8, 13, 30, 60, 150):
        for _ in range(12):
            base = [rng.choice("abcdefgh éüß日本") for _ in range(n)]
            for _ in range(6):
                t = list(base)
                for _ in range(rng.randrange(0, 2 + n // 8)):
                    i = rng.randrange(len(t))
                    what = rng.randrange(4)
                    if what == 0:
                        t[i] = rng.choice("abcdefgh éüß🙂")
                    elif what == 1 and len(t) > 1:
                        del t[i]
                    elif what == 2:
                        t.insert(i, rng.choice("abcß"))
                    elif i:
                        t[i], t[i - 1] = t[i - 1], t[i]
                texts.add("".join(t))
    texts = sorted(texts)
    left, right = texts[::2] + texts[:40], texts[1::2] + texts[:40]
    l, r = (spark.createDataFrame([(x,) for x in sorted(set(t))], "s string") for t in (left, right))
    got = {(x.sl, x.sr): x.d for x in jw_scored(l, r, p, 0.06, half, block_rows=50).withColumn("d", winkler_distance(p)).collect()}
    pairs = [(x, y) for x in set(left) for y in set(right)]
    d = jaro_winkler_distance([x for x, _ in pairs], [y for _, y in pairs], p, half)
    want = {k: v for k, v in zip(pairs, d) if v <= 0.06}
    assert {k: v for k, v in got.items() if v <= 0.06} == pytest.approx(want)


def _compared(ls, rs, p):
    """The share of all pairs that meet in a unit."""
    from termlink.operators.linkage import contrasts, jw_units
    units = jw_units(ls, rs, p, 0.05, contrasts(ls.unionByName(rs))[:-1])
    met = units.groupBy("unit", "family").agg(F.sum(1 - F.col("side")).alias("l"), F.sum("side").alias("r")).agg(F.sum(F.col("l") * F.col("r")))
    return met.first()[0] / (ls.count() * rs.count())


@pytest.mark.parametrize("p", [0.1, 0.15])
def test_few_pairs_meet(spark, p):
    ls, rs = (df.select(F.col("trait").alias("s")).where("s is not null").distinct() for df in (R._rare_left(spark, SF_MID), R._common_right(spark, SF_MID)))
    assert _compared(ls, rs, p) < 0.065


def test_contrasts_keep_every_pair_whatever_the_sets(spark, monkeypatch):
    from termlink.operators import linkage
    monkeypatch.setattr(linkage, "contrasts", lambda strings: [("a", "b"), ("bc", "ea"), ("ab", "")])
    rng = random.Random(8)
    texts = {"".join(rng.choices("abcde", [5, 3, 1, 1, 1], k=rng.randint(8, 14))) for _ in range(300)}
    texts |= {t[:i] + t[i + 1:] for t in sorted(texts) for i in (0, 5)}
    texts = sorted(texts)
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {(x.sl, x.sr) for x in jw_scored(df, df, 0.1, 0.05).withColumn("d", winkler_distance(0.1)).where("d <= 0.05").collect()}
    pairs = [(x, y) for x in texts for y in texts]
    d = jaro_winkler_distance([x for x, _ in pairs], [y for _, y in pairs], 0.1)
    assert got == {k for k, v in zip(pairs, d) if v <= 0.05}


def test_long_and_empty_equal_strings_are_linked(spark):
    left = [("a", "a" * 40_000), ("b", "ab" * 35_000), ("c", ""), ("d", None), ("e", "x" * 70_000)]
    right = [("p", "a" * 40_000), ("q", "ab" * 35_000), ("r", ""), ("s", None), ("t", "x" * 70_000)]
    got = link_fuzzy_jw(spark.createDataFrame(left, "k1 string, t string"), spark.createDataFrame(right, "k2 string, t string"),
                        "t", "k1", "k2").select("k1", "k2").collect()
    assert sorted(map(tuple, got)) == [("a", "p"), ("b", "q"), ("c", "r"), ("e", "t")]


def test_jw_bounds_reject_loose_settings():
    with pytest.raises(ValueError):
        jw_bounds(0.1, 0.5)
    with pytest.raises(ValueError):
        jw_bounds(0.3, 0.05)


def brute_wjaccard(left: pd.DataFrame, right: pd.DataFrame, maxd):
    def toks(s):
        return {t for t in s.strip().split() if t}
    out = {}
    for blk, lb in left.groupby("source"):
        n = {}
        for s in list(lb["trait2"]) + list(right["trait2"]):
            for t in toks(s):
                n[t] = n.get(t, 0) + 1
        w = {t: 1.0 / math.log(1 + c) for t, c in n.items()}
        for _, l in lb.iterrows():
            x = toks(l["trait2"])
            cands = []
            for _, r in right.iterrows():
                y = toks(r["trait2"])
                inter = sum(w[t] for t in x & y)
                if inter == 0:
                    continue
                d = round(1 - inter / (sum(w[t] for t in x) + sum(w[t] for t in y) - inter), 9)
                if d <= maxd:
                    cands.append((d, r["study_name_common"]))
            if cands:
                out[l["study_name_rare"]] = min(cands)
    return out


@pytest.mark.parametrize("common", ["", " everywhere"])
def test_weighted_jaccard_equals_bruteforce(spark, common):
    """Also with one token in every row."""
    left = R._with_trait2(R._rare_left(spark, SF_SMALL)).toPandas().sample(500, random_state=2)
    right = R._with_trait2(R._common_right(spark, SF_SMALL)).toPandas().sample(300, random_state=3)
    left["trait2"], right["trait2"] = left.trait2 + common, right.trait2 + common
    got = link_weighted_jaccard(spark.createDataFrame(left), spark.createDataFrame(right), "trait2", "study_name_rare",
                                "study_name_common", ("_rare", "_common"), max_dist=0.2, block="source",
                                keep_dist=True).toPandas()
    exp = brute_wjaccard(left, right, 0.2)
    got_map = {r.study_name_rare: (r.dist, r.study_name_common) for r in got.itertuples()}
    assert got_map.keys() == exp.keys() and exp
    for k, (d, rk) in exp.items():
        assert got_map[k][1] == rk and abs(got_map[k][0] - d) < 1e-8


def test_exact_nulls_never_match(spark):
    l = spark.createDataFrame([("a", "x"), ("b", None)], "k1 string, trait string")
    r = spark.createDataFrame([("c", "x"), ("d", None)], "k2 string, trait string")
    got = link_exact(l, r, "trait", "k1", "k2").collect()
    assert [(g.k1, g.k2) for g in got] == [("a", "c")]


def test_empty_right_side_gives_empty_result(spark):
    left = R._rare_left(spark, SF_SMALL)
    right = R._common_right(spark, SF_SMALL).where(F.lit(False))
    out = link_fuzzy_jw(left, right, "trait", "study_name_rare", "study_name_common")
    assert out.count() == 0


def test_cascade_stage_counts_match_fixture_table(spark):
    """FIXTURES.md: first stage per left study at sf0.01."""
    m = R.q_link_many_sources(spark, SF_MID)
    order = F.expr("case match_type when 'exact' then 0 when 'fuzzy' then 1 when 'fuzzy2' then 2 "
                   "when 'fuzzy3' then 3 else 4 end")
    first = (m.groupBy("study_name_rare", "source_rare")
             .agg(F.min(F.struct(order.alias("o"), F.col("match_type"))).alias("f"))
             .groupBy("source_rare", "f.match_type").count().collect())
    got = {(r.source_rare, r.match_type): r["count"] for r in first}
    exp = {("rare_a", "exact"): 1153, ("rare_a", "fuzzy"): 54, ("rare_a", "fuzzy2"): 279, ("rare_a", "fuzzy3"): 241, ("rare_a", "fuzzy4"): 75,
           ("rare_b", "exact"): 1197, ("rare_b", "fuzzy"): 60, ("rare_b", "fuzzy2"): 255, ("rare_b", "fuzzy3"): 290, ("rare_b", "fuzzy4"): 58,
           ("rare_c", "exact"): 784, ("rare_c", "fuzzy"): 28, ("rare_c", "fuzzy2"): 179, ("rare_c", "fuzzy3"): 201, ("rare_c", "fuzzy4"): 40}
    assert got == exp


def test_cascade_stages_disjoint_except_fuzzy4(spark):
    m = R.q_link_many_sources(spark, SF_SMALL).toPandas()
    tags = m.groupby("study_name_rare")["match_type"].apply(set)
    for s in tags:
        assert len(s - {"fuzzy4"}) <= 1 or s <= {"fuzzy3", "fuzzy4"}


def test_result_invariant_to_partition_count(spark):
    a = R.q_link_fuzzy_jw(spark, SF_SMALL).toPandas()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        b = R.q_link_fuzzy_jw(spark, SF_SMALL).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    key = ["study_name_rare"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True)[sorted(a.columns)],
                                  b.sort_values(key).reset_index(drop=True)[sorted(b.columns)])


def test_dedupe_before_ignore_order(spark):
    """FIXTURES.md: dedupe → ignore keeps 24,283 rows at sf0.01, ignore → dedupe 24,284."""
    from termlink import fixtures as fx
    from termlink.operators.rows import dedupe_first, exclude_ignored, filter_phenotype
    from termlink.plans.mapping import prepare_traits
    st, ig = fx.studies(spark, SF_MID), fx.ignore_names(spark, SF_MID)
    assert prepare_traits(st, ig).count() == 24283
    other = dedupe_first(exclude_ignored(filter_phenotype(st), ig), "trait", "study_id")
    assert other.count() == 24284


def test_cascade_with_empty_right_side_is_empty(spark):
    """A source with no rows on the right gives an empty result, no error."""
    from termlink.plans.cascade import link_many_sources
    st = R._pheno(spark, SF_SMALL)
    out = link_many_sources(st, ["rare_a", "rare_b"], "no_such_source")
    assert out.count() == 0
    assert "match_type" in out.columns


def test_weighted_jaccard_empty_inputs(spark):
    left = R._with_trait2(R._rare_left(spark, SF_SMALL))
    right = R._with_trait2(R._common_right(spark, SF_SMALL))
    none = right.where(F.lit(False))
    assert link_weighted_jaccard(left, none, "trait2", "study_name_rare", "study_name_common",
                                 block="source").count() == 0
    assert link_weighted_jaccard(left.where(F.lit(False)), right, "trait2", "study_name_rare",
                                 "study_name_common").count() == 0


def made_sides(sources, n, seed=5):
    """A token in every row, short texts, near copies; the left side in so many sources."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]

    def text():
        t = ["the", *rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(0, 7))]
        return " ".join(t)
    base = [text() for _ in range(n)]
    left = pd.DataFrame([(f"l{i}", rng.choice(base) + rng.choice(["", "", " extra"]), f"s{rng.randrange(sources)}") for i in range(n)],
                        columns=["study_name_rare", "trait2", "source"])
    right = pd.DataFrame([(f"r{i}", t, "common") for i, t in enumerate(base)], columns=["study_name_common", "trait2", "source"])
    return left, right


@pytest.mark.parametrize("sources, n, heavy", [(1, 150, 10), (4, 150, 3), (1000, 400, 20)])
def test_weighted_jaccard_with_a_token_in_every_row_and_many_sources(spark, monkeypatch, sources, n, heavy):
    from termlink.operators import jaccard
    monkeypatch.setattr(jaccard, "_HEAVY", heavy)       # frequent tokens' joins are split
    left, right = made_sides(sources, n)
    got = link_weighted_jaccard(spark.createDataFrame(left), spark.createDataFrame(right), "trait2", "study_name_rare", "study_name_common",
                                ("_rare", "_common"), max_dist=0.2, block="source", keep_dist=True).toPandas()
    assert {r.study_name_rare: (r.dist, r.study_name_common) for r in got.itertuples()} == brute_wjaccard(left, right, 0.2)


def test_a_common_value_is_joined_in_many_tasks(spark, monkeypatch):
    from termlink.operators import linkage
    monkeypatch.setattr(linkage, "_GRID", 8)
    texts = ["x"] * 60 + [f"t{i}" for i in range(20)] + [None, None]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k1 int, t string")
    right = spark.createDataFrame([(i, t) for i, t in enumerate(texts[20:])], "k2 int, t string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = link_exact(left, right, "t", "k1", "k2").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.k1, r.k2) for r in rows) == sorted(
        (i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[20:]) if a is not None and a == b)
    assert len({r.task for r in rows if r.t_1 == "x"}) > 1


@pytest.mark.parametrize("copies", [2, 64])
def test_a_common_value_is_shuffled_a_bounded_number_of_times(spark, monkeypatch, copies):
    from termlink.operators import linkage
    monkeypatch.setattr(linkage, "_GRID", 2)
    monkeypatch.setattr(linkage, "_COPIES", copies)
    left = spark.createDataFrame([(i, "x") for i in range(50)], "k1 int, t string")
    right = spark.createDataFrame([(i, "x") for i in range(30)], "k2 int, t string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = link_exact(left, right, "t", "k1", "k2")
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    made, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate":
            made.append(node.metrics().apply("numOutputRows").value())
    assert sorted((r.k1, r.k2) for r in rows) == [(i, j) for i in range(50) for j in range(30)]
    assert sorted(made) == sorted([50 * min(copies, 15), 30 * min(copies, 25)])


def test_exact_members_are_the_pairs_with_a_row_a_member(spark):
    from termlink.operators.linkage import exact_members
    # keys are neither unique nor there in all rows: classes come from the texts
    left = spark.createDataFrame([(i % 7 or None, t) for i, t in enumerate(["x"] * 40 + ["y"] * 10 + ["l", None])], "k1 int, t string")
    right = spark.createDataFrame([(i % 5 or None, t) for i, t in enumerate(["x"] * 30 + ["y"] * 20 + ["r", None])], "k2 int, t string")
    a, b = exact_members(left, right, "t")
    assert a.columns == ["k1", "t", "class"] and b.columns == ["k2", "t", "class"]
    assert a.count() == 50 and b.count() == 50 and {r["class"] for r in a.collect()} == {r["class"] for r in b.collect()}

    def pairs(df):
        return sorted((str(r.k1), str(r.k2), r.t_1, r.t_2) for r in df.collect())
    got, want = pairs(link_exact(a, b, "class", "k1", "k2")), pairs(link_exact(left, right, "t", "k1", "k2"))
    assert got == want and len(got) == 40 * 30 + 10 * 20


def test_exact_matched_has_one_row_a_left_row(spark):
    from termlink.operators.linkage import exact_matched
    left = spark.createDataFrame([(i, "x" if i < 30 else f"l{i}") for i in range(40)], "k1 int, t string")
    right = spark.createDataFrame([(i, "x" if i < 50 else None) for i in range(60)], "k2 int, t string")
    got = exact_matched(left, right, "t", "k1", "k2").select("k1", "k2").collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(30)]


def test_best_pairs_are_the_nearest_of_all(spark):
    from termlink.operators.linkage import jw_scored_pairs
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh ", k=n)) for n in (6, 9, 20, 70, 130, 300) for _ in range(6)]
    texts = set(base)
    for t in base:
        for _ in range(8):
            i = rng.randrange(len(t))
            texts.add(t[:i] + rng.choice("abcz") + t[i + 1:])
    texts = sorted(texts)
    left, right = texts[::2], texts[1::2]
    settings = [(0.1, 0.05), (0.15, 0.05)]
    l, r = (spark.createDataFrame([(x,) for x in t], "s string") for t in (left, right))
    got = jw_scored_pairs(l, r, "s", settings).collect()
    pairs = [(x, y) for x in left for y in right]
    for i, (p, limit) in enumerate(settings):
        want, found = {}, {}
        for (x, y), d in zip(pairs, jaro_winkler_distance([x for x, _ in pairs], [y for _, y in pairs], p)):
            if d <= limit:
                want.setdefault(x, {}).setdefault(float(d), set()).add(y)
        for row in got:
            if row.ds[i] <= limit:
                found.setdefault(row.sl, {}).setdefault(row.ds[i], set()).add(row.sr)
        assert {x: (min(d), d[min(d)]) for x, d in found.items()} == {x: (min(d), d[min(d)]) for x, d in want.items()}


def test_copies_of_strings_do_not_grow_with_the_cells(spark):
    """A cell of some thousand strings is one unit: none is sent to as many blocks as the other side has thousands."""
    from termlink.operators.linkage import jw_units
    left, right = ([(f"{w}{i:04d}",) for i in range(3000)] for w in ("xq", "yq"))
    l, r = (spark.createDataFrame(t, "s string") for t in (left, right))
    units = jw_units(l, r, 0.1, 0.05, [("", ""), ("", "")]).where("family = 0")
    assert units.where("side = 0").count() == 3000


def test_cascade_stores_no_pairs_of_exact_copies(spark, monkeypatch):
    from termlink.plans import cascade
    stored = []
    monkeypatch.setattr(cascade, "cut_lineage", lambda df: stored.append(df.count()) or df.localCheckpoint())
    left = spark.createDataFrame([(f"a{i}", "copied text" if i < 60 else f"other text {i}") for i in range(64)], "k1 string, trait string")
    right = spark.createDataFrame([(f"b{i}", "copied text" if i < 50 else f"other text {i + 10}x") for i in range(54)], "k2 string, trait string")
    out = cascade.link_cascade(left, right, "k1", "k2", ("_1", "_2"), cascade.DEFAULT_STAGES[:2])
    assert {r.match_type: r["count"] for r in out.groupBy("match_type").count().collect()} == {"exact": 3000, "fuzzy": 4}
    assert max(stored) <= 64


def test_weighted_jaccard_lists_only_what_can_match(spark, monkeypatch):
    """Strings with too little in common with the other side leave no token list, and a copied text leaves one."""
    from termlink.operators import jaccard
    stored = {}
    plain = jaccard.stage_parquet

    def spy(df, path):
        out = plain(df, path)
        stored[path.rsplit("/", 1)[-1].rsplit("-", 1)[0]] = out.count()
        return out
    monkeypatch.setattr(jaccard, "stage_parquet", spy)
    long = " ".join(f"w{i}" for i in range(3000))
    left = pd.DataFrame([(f"L{i}", f"a{i} b{i} c{i} both", "s") for i in range(50)] + [(f"M{i}", long + " x", "s") for i in range(20)],
                        columns=["study_name_rare", "trait2", "source"])
    right = pd.DataFrame([("R0", "d e f both", "c"), ("R1", long, "c"), ("R2", long, "c")], columns=["study_name_common", "trait2", "source"])
    got = link_weighted_jaccard(spark.createDataFrame(left), spark.createDataFrame(right), "trait2", "study_name_rare",
                                "study_name_common", block="source").collect()
    assert {(r.study_name_rare, r.study_name_common) for r in got} == {(f"M{i}", "R1") for i in range(20)}
    assert stored["jaccard_left_lists"] == stored["jaccard_right_lists"] == stored["jaccard_pairs"] == 1


def test_fuzzy_units_in_rounds_give_all_pairs_and_their_disk_back(spark, tmp_path, monkeypatch):
    """The same pairs in one round as in many, with many blocks; no round shuffles much more than its share."""
    import random

    from termlink.operators import linkage
    r = random.Random(5)
    words = ["blood", "pressure", "heart", "rate", "left", "right", "asthma", "diabetes", "type", "weight"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(150)]
    left, right = (list({t if r.random() < .5 else t[:r.randint(1, len(t))] + "x" + t[-2:] for t in base for _ in range(3)}) for _ in range(2))
    ls, rs = (spark.createDataFrame([(t,) for t in x], "s string") for x in (left, right))
    monkeypatch.setattr(linkage, "_ROUND_X", 0)
    copies = linkage._cell_sizes(linkage._listed(ls, rs, 0.15, 0.05), 16).agg(F.sum("bytes")).first()[0]
    rounds, dealt = [], linkage._dealt

    def spy(both, sizes, part=0, parts=1):
        out = dealt(both, sizes, part, parts)
        rounds.append((parts, out.count()))
        return out
    monkeypatch.setattr(linkage, "_dealt", spy)
    got = []
    for size in (copies, copies / 6):
        rounds.clear()
        rows = linkage.jw_scored(ls, rs, 0.15, 0.05, block_rows=16, round_bytes=size).collect()
        assert len(rows) == len(set(rows))
        got.append((sorted(rows), rounds[:]))
    (one, whole), (many, parts) = got
    assert one == many and len(one) > 100
    assert [n for n, _ in whole] == [1] and len(parts) == parts[0][0] >= 6
    assert sum(n for _, n in parts) == whole[0][1] and max(n for _, n in parts) < whole[0][1] / 2
