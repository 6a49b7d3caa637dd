"""Curation state, streaming equivalence, LLM parsing, row identity."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from termlink import fixtures as fx
from termlink.operators import curation as cur
from termlink.operators import prompting as llm
from termlink.operators.rows import dense_row_index, dedupe_first, group_row_index
from termlink.plans import registry as R


def test_stream_equals_batch(spark):
    a = R.q_latest_selection(spark, SF_SMALL).toPandas()
    b = R.q_latest_selection_stream(spark, SF_SMALL).toPandas()
    k = ["trait_id"]
    cols = sorted(a.columns)
    pd.testing.assert_frame_equal(a.sort_values(k).reset_index(drop=True)[cols],
                                  b.sort_values(k).reset_index(drop=True)[cols], check_dtype=False)


def test_similarity_label_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (0.0625,)], "s double")
    got = [r[0] for r in df.select(cur.similarity_label("s")).collect()]
    assert got == ["12%", "14%", "6%"]
    df = spark.createDataFrame([(0.12,), (0.5,), (0.1234,), (0.0625,), (1.0,)], "s double")
    got = [r[0] for r in df.select(cur.similarity_label("s", 1)).collect()]
    assert got == ["12%", "50%", "12.3%", "6.2%", "100%"]


def test_next_uncurated_multi_chunk(spark):
    rows = [(1, i, None if i % 3 else "x") for i in range(1, 40)]
    sel = spark.createDataFrame(rows, "worklist long, trait_id long, selected_efo string")
    small = {r.trait_id: r.next_trait_id for r in cur.next_uncurated(sel, chunk=4).collect()}
    big = {r.trait_id: r.next_trait_id for r in cur.next_uncurated(sel, chunk=1 << 20).collect()}
    assert small == big
    assert small[1] == 2 and small[2] == 4 and small[38] == 1   # wraps to the first pending


def test_next_uncurated_with_string_and_null_keys_of_a_worklist(spark):
    rows = [("w", k, s) for k, s in (("EFO:10", None), ("EFO:2", "x"), ("S1", None))] + [(None, "a", "x"), ("done", "b", "x")]
    sel = spark.createDataFrame(rows, "worklist string, trait_id string, selected_efo string")
    got = {r.trait_id: r.next_trait_id for r in cur.next_uncurated(sel, chunk=2).collect()}
    assert got == {"EFO:10": "S1", "EFO:2": "S1", "S1": "EFO:10", "a": None, "b": None}


def test_stream_without_any_choice_has_typed_nulls(spark):
    from termlink.session import staging_path
    from termlink.streaming.selection import latest_selection_stream
    cand = fx.cand(spark, SF_SMALL)
    folder = staging_path(spark, "no_events")
    fx.sel_events(spark, SF_SMALL).limit(0).write.parquet(folder)
    got = latest_selection_stream(spark, cand, cur.rank_options(cand), folder, staging_path(spark, "no_choice"))
    want = cur.latest_selection(cand, fx.sel_events(spark, SF_SMALL).limit(0))
    assert got.dtypes == want.dtypes and got.count() == want.count()
    assert got.where("selected_efo is not null").isEmpty()


def test_stream_reports_an_unreadable_log(spark):
    from termlink.session import staging_path
    from termlink.streaming.selection import read_selection_state
    with pytest.raises(Exception):
        read_selection_state(spark, staging_path(spark, "nowhere")).collect()


def test_profile_of_an_empty_table(spark):
    from termlink.operators.profile import frame_profile
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "")], "x long, y string")
    assert sorted(map(tuple, frame_profile(df).collect())) == [(0, "x", 3, 0, 2, 2), (1, "y", 3, 1, 2, 2)]
    assert sorted(map(tuple, frame_profile(df.limit(0)).collect())) == [(0, "x", 0, 0, 0, 2), (1, "y", 0, 0, 0, 2)]


def _answer(custom_id, content):
    import json
    return (json.dumps({"custom_id": custom_id, "response": {"body": {"choices": [{"message": {"content": content}}]}}}),)


def test_answers_with_white_space_and_match(spark):
    lines = [_answer("a", '\n {"trait": "t", "efo": "e", "confidence": 4} \n'), _answer("b", '{"trait": "t", "match": "m", "confidence": 2}'),
             _answer("c", '{"match": "only"}'), _answer("d", 'text {"trait": "t"}')]
    got = {r.custom_id: (r.trait, r.efo, r["match"], r.confidence, r.parsed) for r in
           llm.parse_llm_response(spark.createDataFrame(lines, "value string")).collect()}
    assert got == {"a": ("t", "e", None, 4.0, True), "b": ("t", None, "m", 2.0, True), "c": (None, None, "only", None, True),
                   "d": (None, None, None, None, False)}


def test_reattach_takes_the_first_row_of_an_id(spark):
    cand = spark.createDataFrame([(1, "Zeta", 5), (1, "alpha", 9), (2, None, 1), (2, "late", 2)], "trait_id long, trait string, efo_id long")
    answers = spark.createDataFrame([("Zeta",), ("alpha",), (None,)], "trait string")
    got = {r.trait: r.trait_id for r in llm.reattach_ids(answers, cand).collect()}
    assert got == {"Zeta": 1, "alpha": None, None: 2}


def test_few_shot_examples_are_chosen_by_candidates_and_quoted(spark):
    pending = spark.createDataFrame([(1, "p1"), (2, "p2")], "trait_id long, trait string")
    known = spark.createDataFrame([(10, "a, \"b\"", "T, x", 7), (11, "later", "T, x", 7), (12, "z", "U", 8), (13, "q", "V", 9)],
                                  "trait_id long, trait string, efo string, efo_id long")
    cand = spark.createDataFrame([(1, 8), (1, 7), (1, 7), (1, 99), (2, 98)], "trait_id long, efo_id long")
    got = {r.trait_id: r.prompt for r in llm.few_shot_prompts(pending, known, cand).collect()}
    assert got == {1: 'Known mappings:\ntrait,efo\n"a, ""b""","T, x"\nz,U\n\nMap the trait "p1" in the same way.',
                   2: 'Known mappings:\ntrait,efo\n\nMap the trait "p2" in the same way.'}


def test_dense_index_contiguous(spark):
    s = fx.studies(spark, SF_SMALL).select("study_name")
    idx = dense_row_index(s, ["study_name"], "idx", num_partitions=5).toPandas().sort_values("study_name")
    assert list(idx.idx) == list(range(len(idx)))


def test_group_index_splits_hot_group(spark):
    df = spark.range(0, 1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    out = group_row_index(df, ["g"], [F.col("v").desc()], "rn", start=1, num_partitions=7).toPandas()
    for g, part in out.groupby("g"):
        assert list(part.sort_values("v", ascending=False).rn) == list(range(1, 501))


def test_dedupe_first_keeps_null_key_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, o long")
    got = {(r.k, r.o) for r in dedupe_first(df, "k", "o").collect()}
    assert got == {(None, 1), ("a", 5)}


def test_parse_handles_broken_answers(spark):
    lines = spark.createDataFrame([
        ('{"custom_id":"a","response":{"body":{"choices":[{"message":{"content":"{\\"trait\\":\\"t\\",\\"efo\\":\\"e\\",\\"confidence\\":4}"}}]}}}',),
        ('{"custom_id":"b","response":{"body":{"choices":[{"message":{"content":"{\\"trait\\":\\"t\\",\\"efo\\":\\"e\\",\\"confidence\\":\\"high\\"}"}}]}}}',),
        ('{"custom_id":"c","response":{"body":{"choices":[{"message":{"content":"{\\"trait\\":\\"t\\""}}]}}}',),
        ("",)], "value string")
    parsed = llm.parse_llm_response(lines)
    kept, bad = llm.quarantine_bad_answers(parsed)
    k = {r.custom_id: (r.confidence, r.reason) for r in kept.collect()}
    assert k == {"a": (4.0, None), "b": (None, "non_numeric_confidence")}
    assert [r.custom_id for r in bad.collect()] == ["c"]


def test_prompt_interpolates_braces(spark):
    cand = spark.createDataFrame([(1, "t1", "x", 10, 0.5), (1, "t1", "y", 11, 0.9)],
                                 "trait_id long, trait string, efo string, efo_id long, similarity double")
    p = llm.build_prompts(cand).collect()[0].prompt
    assert "- y\n- x." in p and '{"trait": "t1", "efo": "<efo term>"' in p


def test_token_cost_constants(spark):
    prompts = spark.range(19553).select(F.lit("x").alias("prompt"))
    r = llm.token_cost(prompts, input_tokens_estimate=500).collect()[0]
    assert abs(r.input_cost - 12.220625) < 1e-9 and abs(r.output_cost - 2.93295) < 1e-9


def test_all_prompt_wordings_interpolate(spark):
    cand = spark.createDataFrame([(1, "asthma", "a", 10, 0.9), (1, "asthma", "b", 11, 0.5)],
                                 "trait_id long, trait string, efo string, efo_id long, similarity double")
    for template in (llm.PROMPT_TRAIT_TERM, llm.PROMPT_TRAIT_TRAIT, llm.PROMPT_LOCAL):
        p = llm.build_prompts(cand, template).collect()[0].prompt
        assert p.count('"asthma"') >= 2          # the trait, also inside the JSON example
        assert "- a\n- b" in p
        assert "{{" not in p and "{trait}" not in p and "{bullets}" not in p


def test_group_index_null_group_and_anti_join_keeps_nulls(spark):
    from termlink.operators.rows import exclude_ignored
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, v long")
    out = {(r.g, r.v): r.rn for r in group_row_index(df, ["g"], ["v"], "rn", start=1).collect()}
    assert out == {(None, 1): 1, (None, 3): 2, ("a", 2): 1}
    names = spark.createDataFrame([("S1",), (None,), ("S2",)], "study_name string")
    ignore = spark.createDataFrame([("S2",), (None,)], "study_name string")
    kept = sorted((r.study_name or "") for r in exclude_ignored(names, ignore).collect())
    assert kept == ["", "S1"]          # the null name stays, S2 goes
