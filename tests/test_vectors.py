"""Block top-k against a numpy brute force; cosine guard; embedding."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from termlink import fixtures as fx
from termlink.operators.vectors import cosine_one_to_all, embed_terms, topk_cosine


def test_topk_equals_bruteforce_with_small_blocks(spark):
    a = fx.traits_vec(spark, SF_SMALL)
    b = fx.onto_vec(spark, SF_SMALL)
    got = topk_cosine(a, b, 7, block_rows=64, broadcast_bytes=0).toPandas()      # many balls
    whole = topk_cosine(a, b, 7).toPandas()
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, whole.to_numpy()))
    A = a.toPandas(); B = b.toPandas()
    MA = np.stack(A.vec.to_numpy()).astype(float); MB = np.stack(B.vec.to_numpy()).astype(float)
    S = np.round((MA @ MB.T) / np.outer(np.linalg.norm(MA, axis=1), np.linalg.norm(MB, axis=1)), 9)
    for i, aid in enumerate(A.id):
        order = np.lexsort((B.id.to_numpy(), -S[i]))[:7]
        exp = list(B.id.to_numpy()[order])
        g = got[got.a_id == aid].sort_values("rank")
        assert list(g.b_id) == exp
        assert list(g["rank"]) == list(range(1, 8))


def test_zero_vector_gives_zero_similarity(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "id long, vec array<double>")
    got = {r.other_id: r.similarity for r in cosine_one_to_all(df, 1).collect()}
    assert got == {2: 0.0, 3: 0.0}
    top = topk_cosine(df.where("id = 1"), df.where("id != 1"), 2).collect()
    assert sorted((r.b_id, r.similarity) for r in top) == [(2, 0.0), (3, 0.0)]


def test_embedding_rows_sum_to_one_and_custom_encoder(spark):
    d = fx.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    v = embed_terms(d, "doc_id", "text").select(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert all(abs(r.s - 1.0) < 1e-6 for r in v.collect())

    def enc(texts):
        return np.stack([[len(t), t.count(" ")] for t in texts]).astype(float)
    out = embed_terms(d.limit(5), "doc_id", "text", encoder=enc).collect()
    assert len(out) == 5 and all(len(r.vec) == 2 for r in out)
    out2 = embed_terms(d.limit(5), "doc_id", "text", encoder_factory=lambda: enc).collect()
    assert sorted((r.doc_id, list(r.vec)) for r in out2) == sorted((r.doc_id, list(r.vec)) for r in out)


def test_balls_are_exact_and_skip_work(spark):
    """Clusters, copies, zero vectors and ties by id, in string ids; a ball of more than a block."""
    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 8))
    x = np.concatenate([centres[r.integers(0, 12, 400)] + 0.05 * r.standard_normal((400, 8)), np.tile(centres[0], (150, 1)), np.zeros((6, 8))])
    ids = [f"B{i}" for i in r.permutation(len(x))]
    y = np.concatenate([centres + 0.02 * r.standard_normal(centres.shape), r.standard_normal((20, 8)), np.zeros((2, 8))])
    b = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<double>")
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, vec array<double>")
    norm = [np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300), 0) for m in (y, x)]
    S = np.round(norm[0] @ norm[1].T, 9)
    for k in (5, 40, 1000):
        work = {}
        got = topk_cosine(a, b, k, block_rows=24, broadcast_bytes=0, work=work)
        want = {i: sorted(zip(-S[i], ids))[:k] for i in range(len(y))}
        have = {}
        for row in got.collect():
            have.setdefault(row.a_id, {})[row["rank"]] = row.b_id
        for i in want:
            top = [have[i][n + 1] for n in range(len(have[i]))]
            assert len(top) == min(k, len(x))
            place = {v: n for n, v in enumerate(ids)}
            assert np.allclose([S[i, place[t]] for t in top], [-s for s, _ in want[i]], atol=2e-9)
        assert k > 5 or work["products"] < 0.6 * work["all"]
        assert work["products"] <= work["all"]


def test_topk_with_empty_side(spark):
    a = fx.traits_vec(spark, SF_SMALL)
    empty = fx.onto_vec(spark, SF_SMALL).where(F.lit(False))
    assert topk_cosine(a, empty, 5).count() == 0
    assert topk_cosine(empty, a, 5).count() == 0
    assert topk_cosine(a, empty, 5, broadcast_bytes=-1).count() == topk_cosine(empty, a, 5, broadcast_bytes=0).count() == 0


def test_topk_keeps_string_ids_and_breaks_ties_by_id(spark):
    a = spark.createDataFrame([("S1", [1.0, 0.0]), ("S2", [0.0, 1.0]), (None, [1.0, 1.0])], "id string, vec array<double>")
    b = spark.createDataFrame([("EFO:2", [2.0, 0.0]), ("EFO:10", [1.0, 0.0]), ("EFO:1", [0.0, 3.0])], "id string, vec array<double>")
    got = sorted((r.a_id, r["rank"], r.b_id, r.similarity) for r in topk_cosine(a, b, 2).collect())
    assert got == [("S1", 1, "EFO:10", 1.0), ("S1", 2, "EFO:2", 1.0), ("S2", 1, "EFO:1", 1.0), ("S2", 2, "EFO:10", 0.0)]


def test_mapping_takes_studies_of_any_source_and_of_none(spark):
    from termlink.plans.mapping import map_traits_to_terms
    studies = spark.createDataFrame([("s0", "red fox", None, "common", "phenotype", 1, 0), ("s1", "blue sky", "ebi_catalog", "common", "phenotype", 1, 1),
                                     ("s2", "grey", "x", "common", "gene", 1, 2)],
                                    "study_name string, trait string, source string, variant_type string, data_type string, sample_size long, study_id long")
    onto = spark.createDataFrame([(1, "sky"), (2, "fox")], "id long, term string")
    got = map_traits_to_terms(studies, studies.limit(0).select("study_name"), onto, k=1).collect()
    assert {(r.trait_id, r.efo_id) for r in got} == {("s0", 2), ("s1", 1)}


def test_mapping_with_string_ids_scores_each_text_once(spark):
    from termlink.plans.mapping import map_traits_to_terms
    studies = spark.createDataFrame([(f"s{i}", t, "common", "common", "phenotype", 1, i) for i, t in enumerate(["red fox", "blue sky", "red fox!"])],
                                    "study_name string, trait string, source string, variant_type string, data_type string, sample_size long, study_id long")
    onto = spark.createDataFrame([(f"EFO:{i}", t) for i, t in enumerate(["fox red", "sky", "fox red", "sky blue", "fox red", None])], "id string, term string")
    got = map_traits_to_terms(studies, studies.limit(0).select("study_name"), onto, k=2).collect()
    assert {(r.trait_id, r["rank"], r.efo_id) for r in got} == {
        ("s0", 1, "EFO:0"), ("s0", 2, "EFO:2"), ("s1", 1, "EFO:3"), ("s1", 2, "EFO:1"), ("s2", 1, "EFO:0"), ("s2", 2, "EFO:2")}


def test_ids_are_attached_only_to_texts_that_can_be_chosen(spark, monkeypatch):
    from termlink.plans import mapping
    k, texts, ids = 5, 5, 8
    top = spark.createDataFrame([(a, b * ids, 1.0 - (b // 2) / 10, b + 1) for a in range(30) for b in range(texts)],
                                "a_id long, b_id long, similarity double, rank long")
    terms = spark.createDataFrame([(b * ids + i, f"h{b}", 1) for b in range(texts) for i in range(ids)], "id long, __h string, __n int")
    joined, plain = [], type(top).join

    def spy(self, other, *args, **kw):
        if set(self.columns) == {"a_id", "b_id", "similarity"} and set(other.columns) == {"b_id", "id"}:
            joined.append(self.count())
        return plain(self, other, *args, **kw)
    monkeypatch.setattr(type(top), "join", spy)
    got = sorted(tuple(r) for r in mapping.expand_terms(top, terms, k).collect())
    # two texts are equally good and best; the smaller ids are those of the first
    assert got == [(a, i, 1.0, i + 1) for a in range(30) for i in range(k)]
    assert joined == [30 * 2]


def test_mapping_shuffles_neither_vectors_nor_candidates(spark, monkeypatch):
    """Nothing but the traits themselves goes through an exchange; a study name on two rows is deduped, an id of two texts told once."""
    from termlink.plans import mapping
    cols = "study_name string, trait string, source string, variant_type string, data_type string, sample_size long, study_id long"
    texts = ["red fox", "blue sky", "red fox!", "fox red red", "...", "sky", None]
    studies = spark.createDataFrame([("s1" if i == 1 else f"s{i - i % 2 if i == 5 else i}", t, "x", "common", "phenotype", 1, i) for i, t in enumerate(texts)], cols)
    onto = spark.createDataFrame([(0, "fox red"), (1, "sky"), (2, "fox red"), (3, "sky blue"), (4, "fox red"), (4, "sky"), (5, None)], "id long, term string")
    none = studies.limit(0).select("study_name")
    got = mapping.map_traits_to_terms(studies.where("study_id != 5"), none, onto, k=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]       # the distinct terms, before they are broadcast
    assert len(moved) == 1 and "Scan ExistingRDD" not in plan[:plan.index("BroadcastExchange")]
    monkeypatch.setattr(mapping, "fits_whole", lambda *a: False)
    want = mapping.map_traits_to_terms(studies, none, onto, k=4)
    monkeypatch.undo()
    have = mapping.map_traits_to_terms(studies, none, onto, k=4)
    key = ["trait_id", "trait", "efo_id", "similarity", "rank"]
    assert want.columns == have.columns
    rows = [sorted(map(tuple, df.select(key).collect())) for df in (have, want)]
    assert rows[0] == rows[1] and len({r[:3:2] for r in rows[0]}) == len(rows[0])
