"""DuckDB SQL twins of :mod:`termlink.plans.registry` (the correctness gate).

Each string runs on DuckDB with the given tables registered as views; the
fixture views of :mod:`termlink.fixtures` are prepended as CTEs. The SQL is
written independently of the Spark plans: plain joins, windows and
aggregates over all pairs where the Spark side prunes.

Jaro-Winkler: DuckDB's ``jaro_similarity`` floors half the transposition
count, so its distance is never above the exact one and it only discards
pairs; the others get the exact Jaro (t = half the out-of-order matches, as the
matching library the reference calls defines it) from a SQL fold over the
characters. Nothing here is imported from the code under test but the
fixture views.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from termlink.fixtures import with_views

NL = "chr(10)"

# The deletions of boilerplate, in order.
DELETIONS = [
    r"Diagnoses - main ICD10: [A-Z][0-9]+(\.[0-9]+)?\s*",
    r"Operative procedures - main OPCS: [A-Z][0-9]+(\.[0-9]+)?\s*",
    r"Diagnoses - secondary ICD10: [A-Z][0-9]+(\.[0-9]+)?\s*",
    r"Operative procedures - secondary OPCS: [A-Z][0-9]+(\.[0-9]+)?\s*",
    r"Operative procedures - main OPCS4 \([A-Z][0-9]+(\.[0-9]+)?\s*",
    r"Operative procedures - secondary OPCS4 \([A-Z][0-9]+(\.[0-9]+)?\s*",
    r"Non-cancer illness code, self-reported:",
    r"Benign neoplasm:",
    r"Malignant neoplasm:",
    r"Operation code:",
    r"Treatment/medication code:",
    r"Medication use",
    r"levels$",
    r"Firth correction",
    r"SPA correction",
    r"UKB data field \d+",
    r"Non-cancer illness code",
    r"self reported",
    r"^Ever had",
    r"^NMR",
    r"automated reading",
    r"^ICD10 [A-Z][0-9]+(\.[0-9]+)?\s*",
]

# Prompt wordings; {trait} and {bullets} are filled in.
WORDING_TERM = (
    'Match the trait "{trait}" to the best EFO term from this list:\n\n{bullets}.\n\n'
    'Return JSON: {"trait": "{trait}", "efo": "<efo term>", "confidence":<score 1-5>}.')
WORDING_TRAIT = (
    'This is a term used to describe a trait that I analysed in genome-wide association study: '
    '"{trait}". These were traits used in another study listed below. Find a trait from the list '
    'below that best matches my trait.\n\n{bullets}.\n\nI do not expect an exact match, but getting '
    'something that is conceptually close will suffice. Return your answer in json format with the '
    'format {"trait": "{trait}", "match": "<other trait>", "confidence":<score>}, where the '
    '"confidence" field represents on a scale of 1-5 how closely the trait matches, where 1 is very '
    'loose and 5 is a perfect match.')
WORDING_LOCAL = (
    'This is a term used to describe a trait that was analysed in genome-wide association study: '
    '"{trait}". Find the most appropriate EFO term for this trait from the list below. I do not '
    'expect an exact match, but getting something that is conceptually close will suffice:\n\n'
    '{bullets}\n\nWhen you find an EFO term that is conceptually close, make sure to return the exact '
    'efo term. Return your answer in json format with the format {"trait": "{trait}", "efo": '
    '"<efo term>", "confidence":<score>}, where the "confidence" field represents on a scale of 1-5 '
    'how closely the trait matches, where 1 is very loose and 5 is a perfect match.')


class Step(NamedTuple):
    """A step of the cascade: how, on which column, prefix weight, largest distance, and whether it
    takes what earlier steps left over (else the same rows as the step before it)."""

    tag: str
    how: str
    column: str
    p: float = 0.0
    most: float = 0.0
    left_over: bool = True


STEPS = [
    Step("exact", "exact", "trait"),
    Step("fuzzy", "jw", "trait", 0.1, 0.05),
    Step("fuzzy2", "jw", "trait2", 0.1, 0.05),
    Step("fuzzy3", "jw", "trait2", 0.15, 0.05),
    Step("fuzzy4", "wjaccard", "trait2", 0.0, 0.2, False),
]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# building blocks
# ---------------------------------------------------------------------------

def trait2_sql(col: str = "trait") -> str:
    return (f"regexp_replace(lower(regexp_replace({col}, '[^\\pL\\pN$]', ' ', 'g')), "
            f"'\\s+', ' ', 'g')")


def clean_ascii_sql(x: str) -> str:
    return (f"lower(trim(regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9\\s]', ' ', 'g'), "
            f"'\\s+', ' ', 'g')))")


def _prefix_len_sql(a: str, b: str) -> str:
    pref = " ".join(
        f"WHEN length({a}) >= {k} AND length({b}) >= {k} AND left({a}, {k}) = left({b}, {k}) THEN {k}"
        for k in (4, 3, 2, 1))
    return f"(CASE {pref} ELSE 0 END)"


# letters beyond ASCII that the documents use, renamed to single bytes for the prefilter
LETTERS = "äéêèçßüñöóíÓÉÇÑÖÊÈÄÜÍ"
NARROW = [n for n in range(1, 32) if n not in (9, 10, 11, 12, 13)][:len(LETTERS)]


def narrow_sql(x: str) -> str:
    return f"translate({x}, {_q(LETTERS)}, {' || '.join(f'chr({n})' for n in NARROW)})"


def jaro_state_sql(lb: str) -> str:
    """Greedy Jaro matching of the lists xa, ya as a fold over the positions of xa: the
    state holds the used-flags of ya and the matched-flags of xa."""
    w = f"greatest(0, greatest(len(xa), {lb}) // 2 - 1)"
    j = (f"coalesce(list_filter(range(greatest(1, i - {w}), least({lb}, i + {w}) + 1), "
         f"lambda j: ya[j] = xa[i] AND substr(s.ub, j, 1) = '0')[1], 0)")
    return (f"list_reduce(range(1, len(xa) + 1), lambda s, i: struct_pack(ub := CASE WHEN {j} > 0 THEN "
            f"substr(s.ub, 1, {j} - 1) || '1' || substr(s.ub, {j} + 1) ELSE s.ub END, "
            f"ua := s.ua || CASE WHEN {j} > 0 THEN '1' ELSE '0' END), "
            f"struct_pack(ub := repeat('0', {lb}), ua := ''))")


def jaro_exact_sql() -> str:
    """Jaro from the fold state st, with t = half the out-of-order matches."""
    m = "length(replace(st.ua, '0', ''))"
    sa = "list_filter(xa, lambda x, k: substr(st.ua, k, 1) = '1')"
    sb = "list_filter(ya, lambda x, k: substr(st.ub, k, 1) = '1')"
    t = f"len(list_filter(list_zip({sa}, {sb}), lambda z: z[1] <> z[2]))"
    return (f"CASE WHEN {m} = 0 THEN 0.0 ELSE ({m} / len(xa) + {m} / len(ya) + "
            f"({m} - {t} / 2.0) / {m}) / 3.0 END")


def cos_sql(a: str, b: str) -> str:
    def dot(x, y):
        return (f"list_reduce(list_transform(range(1, len({x}) + 1), lambda i: {x}[i] * {y}[i]), "
                f"lambda s, t: s + t)")
    return (f"CASE WHEN sqrt({dot(a, a)}) = 0 OR sqrt({dot(b, b)}) = 0 THEN 0.0 "
            f"ELSE {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) END")


def tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda t: t <> ''))"


PHENO = "pheno AS (SELECT * FROM studies WHERE data_type = 'phenotype' AND source <> 'ebi_catalog')"


def lr_ctes(sources=("rare_a", "rare_b", "rare_c"), trait2: bool = False) -> str:
    src = ", ".join(_q(s) for s in sources)
    t2 = f", {trait2_sql()} AS trait2" if trait2 else ""
    return (f"{PHENO},\n"
            f"l AS (SELECT study_name AS study_name_rare, trait, source{t2} FROM pheno "
            f"WHERE source IN ({src}) AND variant_type = 'rare_exome'),\n"
            f"r AS (SELECT study_name AS study_name_common, trait, source{t2} FROM pheno "
            f"WHERE source = 'common' AND variant_type = 'common')")


def best_jw_sql(lt: str, rt: str, lk: str, rk: str, col: str, p: float, maxd: float) -> str:
    """Distinct strings of similar length are paired; DuckDB's own Jaro (which floors half the
    transpositions, so it is never below the exact one) discards most; the rest is scored exactly.
    It works on bytes, so the letters beyond ASCII are renamed; strings with still others pass it."""
    j = 1 - maxd / (1 - 4 * p)
    k = 3 * j - 2

    def side(t, c, x):
        return (f"SELECT DISTINCT {c} AS {x}, length({c}) AS n, {narrow_sql(c)} AS z FROM {t} WHERE {c} IS NOT NULL")

    plain = "strlen(a.z) = a.n AND strlen(b.z) = b.n"
    floor_d = f"(1 - jaro_similarity(a.z, b.z)) * (1 - {p} * {_prefix_len_sql('a.z', 'b.z')})"
    exact_d = f"round((1 - {jaro_exact_sql()}) * (1 - {p} * {_prefix_len_sql('x', 'y')}), 9)"
    return f"""SELECT {lk}, {rk}, dist FROM (
  WITH ls AS ({side(lt, col, 'x')}), rs AS ({side(rt, col, 'y')}),
       near AS (SELECT a.x, b.y FROM ls a JOIN rs b ON b.n >= a.n * {k} - 1e-6 AND b.n <= a.n / {k} + 1e-6
                WHERE a.x <> b.y AND CASE WHEN {plain} THEN {floor_d} <= {maxd} + 1e-9 ELSE true END),
       lists AS (SELECT x, y, string_split(x, '') AS xa, string_split(y, '') AS ya FROM near),
       states AS (SELECT *, {jaro_state_sql('len(ya)')} AS st FROM lists),
       scored AS (SELECT x, y, {exact_d} AS dist FROM states
                  UNION ALL SELECT x, x, 0.0 FROM ls JOIN rs ON x = y)
  SELECT a.{lk}, b.{rk}, dist, row_number() OVER (PARTITION BY a.{lk} ORDER BY dist, b.{rk}) AS rn
  FROM scored JOIN {lt} a ON a.{col} = x JOIN (SELECT {col}, min({rk}) AS {rk} FROM {rt} GROUP BY {col}) b ON b.{col} = y
  WHERE dist <= {maxd}) WHERE rn = 1"""


def best_wjac_sql(lt: str, rt: str, lk: str, rk: str, col: str, maxd: float, block: str | None) -> str:
    b = f"a.{block}" if block else "''"
    return f"""SELECT {lk}, {rk}, dist FROM (
  WITH lt AS (SELECT DISTINCT {lk}, b, t FROM (SELECT a.{lk}, {b} AS b,
                unnest({tokens_sql('a.' + col)}) AS t FROM {lt} a WHERE a.{col} IS NOT NULL)),
       rt AS (SELECT DISTINCT {rk}, t FROM (SELECT c.{rk}, unnest({tokens_sql('c.' + col)}) AS t
                FROM {rt} c WHERE c.{col} IS NOT NULL)),
       lc AS (SELECT b, t, count(*) AS nl FROM lt GROUP BY b, t),
       rc AS (SELECT t, count(*) AS nr FROM rt GROUP BY t),
       blocks AS (SELECT DISTINCT b FROM lt),
       bt AS (SELECT b, t FROM lc UNION SELECT blocks.b, rc.t FROM blocks CROSS JOIN rc),
       w AS (SELECT bt.b, bt.t, 1.0 / ln(1 + coalesce(lc.nl, 0) + coalesce(rc.nr, 0)) AS w
             FROM bt LEFT JOIN lc ON lc.b = bt.b AND lc.t = bt.t LEFT JOIN rc ON rc.t = bt.t),
       wx AS (SELECT lt.{lk}, lt.b, sum(w.w) AS wx FROM lt JOIN w ON w.b = lt.b AND w.t = lt.t
              GROUP BY lt.{lk}, lt.b),
       wy AS (SELECT blocks.b, rt.{rk}, sum(w.w) AS wy FROM blocks JOIN rt ON true
              JOIN w ON w.b = blocks.b AND w.t = rt.t GROUP BY blocks.b, rt.{rk}),
       -- a match shares more than the weight of all but the left string's heaviest tokens, so it shares
       -- one of these
       heavy AS (SELECT {lk}, b, t FROM (SELECT lt.{lk}, lt.b, lt.t, sum(w.w) OVER (PARTITION BY lt.{lk}, lt.b
                   ORDER BY w.w, lt.t) AS rest, sum(w.w) OVER (PARTITION BY lt.{lk}, lt.b) AS total
                 FROM lt JOIN w ON w.b = lt.b AND w.t = lt.t) WHERE rest >= {1 - maxd} * total - 1e-6),
       cand AS (SELECT DISTINCT heavy.{lk}, heavy.b, rt.{rk} FROM heavy JOIN rt ON rt.t = heavy.t),
       it AS (SELECT c.{lk}, c.b, c.{rk}, sum(w.w) AS i FROM cand c JOIN lt ON lt.{lk} = c.{lk} AND lt.b = c.b
              JOIN rt ON rt.{rk} = c.{rk} AND rt.t = lt.t JOIN w ON w.b = lt.b AND w.t = lt.t
              GROUP BY c.{lk}, c.b, c.{rk}),
       sc AS (SELECT it.{lk}, it.{rk}, round(1 - it.i / (wx.wx + wy.wy - it.i), 9) + 0.0 AS dist
              FROM it JOIN wx ON wx.{lk} = it.{lk} AND wx.b = it.b
              JOIN wy ON wy.b = it.b AND wy.{rk} = it.{rk})
  SELECT *, row_number() OVER (PARTITION BY {lk} ORDER BY dist, {rk}) AS rn FROM sc
  WHERE dist <= {maxd}) WHERE rn = 1"""


def suffixed_select(pairs: str, lt: str, rt: str, lk: str, rk: str, lcols, rcols, sfx, extra="") -> str:
    lsel = ", ".join([f"x.{lk}"] + [f"x.{c} AS {c}{sfx[0]}" for c in lcols])
    rsel = ", ".join([f"y.{rk}"] + [f"y.{c} AS {c}{sfx[1]}" for c in rcols])
    ex = f", {extra}" if extra else ""
    return (f"SELECT {lsel}, {rsel}{ex} FROM ({pairs}) m JOIN {lt} x ON x.{lk} = m.{lk} "
            f"JOIN {rt} y ON y.{rk} = m.{rk}")


def cascade_sql(left_cte: str, right_cte: str, lk: str, rk: str, cols, sfx,
                stages=STEPS, block: str | None = None) -> str:
    """Full cascade in SQL: stage inputs as anti-joined CTEs, tagged union."""
    ctes = [left_cte, right_cte,
            f"l2 AS MATERIALIZED (SELECT *, {trait2_sql()} AS trait2 FROM l0)",
            f"r2 AS MATERIALIZED (SELECT *, {trait2_sql()} AS trait2 FROM r0)"]
    cur = "l2"
    matched: list[str] = []
    for i, st in enumerate(stages):
        if i > 0 and st.left_over:
            keys = " UNION ALL ".join(f"SELECT {lk} FROM m{j}" for j in range(i))
            ctes.append(f"in{i} AS MATERIALIZED (SELECT * FROM l2 WHERE {lk} NOT IN ({keys}))")
            cur = f"in{i}"
        if st.how == "exact":
            body = (f"SELECT a.{lk}, b.{rk} FROM {cur} a JOIN r2 b ON a.{st.column} = b.{st.column}")
        elif st.how == "jw":
            body = best_jw_sql(cur, "r2", lk, rk, st.column, st.p, st.most)
            body = f"SELECT {lk}, {rk} FROM ({body})"
        else:
            body = best_wjac_sql(cur, "r2", lk, rk, st.column, st.most, block)
            body = f"SELECT {lk}, {rk} FROM ({body})"
        ctes.append(f"m{i} AS MATERIALIZED ({body})")
        matched.append(f"SELECT {lk}, {rk}, {_q(st.tag)} AS match_type FROM m{i}")
    pairs = " UNION ALL ".join(matched)
    sel = suffixed_select(pairs, "l2", "r2", lk, rk, cols, cols, sfx, "m.match_type")
    return "WITH " + ",\n".join(ctes) + "\n" + sel


# ---------------------------------------------------------------------------
# prompts / answers
# ---------------------------------------------------------------------------

def prompt_sql(wording: str = WORDING_TERM) -> str:
    pieces = []
    for piece in re.split(r"(\{trait\}|\{bullets\}|\n)", wording):
        if piece in ("{trait}", "{bullets}"):
            pieces.append(piece[1:-1])
        elif piece == "\n":
            pieces.append(NL)
        elif piece:
            pieces.append(_q(piece))
    return " || ".join(pieces)


BULLETS = f"""bullets AS (SELECT trait, string_agg('- ' || efo, {NL} ORDER BY similarity DESC, efo_id, efo)
                    AS bullets FROM cand GROUP BY trait)"""
def prompts_sql(wording: str) -> str:
    return (f"prompts AS (SELECT b.trait, f.first_id, {prompt_sql(wording)} AS prompt FROM bullets b "
            "JOIN (SELECT trait, min(trait_id) AS first_id FROM cand GROUP BY trait) f USING (trait))")


PROMPTS = prompts_sql(WORDING_TERM)
REQUESTS = """requests AS (SELECT idx, idx // 1000 AS batch, 'req-' || idx AS custom_id,
              'gpt-4o-mini-2024-07-18' AS model, CAST(1000 AS BIGINT) AS max_tokens,
              md5(prompt) AS prompt_md5, trait, prompt
              FROM (SELECT *, row_number() OVER (ORDER BY first_id, trait) - 1 AS idx FROM prompts))"""


def answer_cols(content: str) -> str:
    content = f"trim({content}, ' ' || chr(9) || chr(10) || chr(13))"
    ok = f"(starts_with({content}, '{{') AND json_valid({content}))"
    c = f"(CASE WHEN {ok} THEN {content} END)"   # never hand malformed text to the extractor
    return (f"json_extract_string({c}, '$.trait') AS trait, "
            f"json_extract_string({c}, '$.efo') AS efo, json_extract_string({c}, '$.match') AS match, "
            f"json_extract_string({c}, '$.confidence') AS confidence_raw, "
            f"TRY_CAST(json_extract_string({c}, '$.confidence') AS DOUBLE) AS confidence, "
            f"coalesce({ok} AND (json_extract_string({c}, '$.trait') IS NOT NULL "
            f"OR json_extract_string({c}, '$.efo') IS NOT NULL OR json_extract_string({c}, '$.match') IS NOT NULL), "
            f"false) AS parsed")


PARSED = f"""parsed AS (SELECT custom_id, {answer_cols('content')} FROM (
    SELECT json_extract_string(value, '$.custom_id') AS custom_id,
           json_extract_string(value, '$.response.body.choices[0].message.content') AS content
    FROM llm_lines WHERE length(value) > 0))"""
FREE_PARSED = f"""free_parsed AS (SELECT trait_id, {answer_cols('content')} FROM (
    SELECT trait_id, array_to_string(list_filter(string_split(response, {NL}),
           lambda x: starts_with(x, '{{')), {NL}) AS content FROM llm_free))"""
SELECTIONS = """choices AS (SELECT e.trait_id, e.rank, e.event_id, e.ts, o.efo, o.efo_id, o.similarity
                FROM sel_events e JOIN rank_options o ON o.trait_id = e.trait_id AND o.rank = e.rank),
selections AS (SELECT t.trait_id, t.trait, c.efo AS selected_efo, c.efo_id AS selected_efo_id,
                      c.similarity AS selected_similarity
               FROM (SELECT DISTINCT trait_id, trait FROM cand) t
               LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trait_id
                          ORDER BY ts DESC, event_id DESC) AS rn FROM choices) WHERE rn = 1) c
               USING (trait_id))"""


def _w(sql: str, *views: str) -> str:
    return with_views(sql, *views)


def _topk(a_where: str, b_where: str, k: int, a_name: str, b_name: str) -> str:
    return f"""WITH a AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {a_where}),
b AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {b_where}),
s AS (SELECT a.id AS aid, b.id AS bid, round({cos_sql('a.v', 'b.v')}, 9) AS similarity FROM a JOIN b ON true)
SELECT aid AS {a_name}, bid AS {b_name}, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY aid ORDER BY similarity DESC, bid) AS rank FROM s)
WHERE rank <= {k}"""


def _boiler_input_sql() -> str:
    code = "chr(65 + CAST(doc_id % 26 AS INTEGER)) || CAST(doc_id % 100 AS VARCHAR) || '.' || CAST(doc_id % 7 AS VARCHAR)"
    return (f"(CASE WHEN doc_id % 5 = 0 THEN 'Diagnoses - main ICD10: ' || {code} || ' ' "
            f"WHEN doc_id % 5 = 1 THEN 'Non-cancer illness code, self-reported: ' "
            f"WHEN doc_id % 5 = 2 THEN 'Ever had ' "
            f"WHEN doc_id % 5 = 3 THEN 'ICD10 ' || {code} || ': ' ELSE '' END || text)")


def _strip_sql(x: str) -> str:
    for p in DELETIONS:
        x = f"regexp_replace({x}, {_q(p)}, '', 'g')"
    return clean_ascii_sql(x)


# ---------------------------------------------------------------------------
# the oracle table
# ---------------------------------------------------------------------------

def _exact_pairs() -> str:
    return "SELECT a.study_name_rare, b.study_name_common FROM l a JOIN r b ON a.trait = b.trait"


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    lrc = lr_ctes()
    lrc2 = lr_ctes(trait2=True)
    exact_full = suffixed_select(_exact_pairs(), "l", "r", "study_name_rare", "study_name_common",
                                 ["trait", "source"], ["trait", "source"], ("_rare", "_common"))

    # 2.1 sources and sinks
    o["scan_delimited"] = _w("SELECT study_name, trait, source, variant_type, data_type, sample_size, "
                             "study_id FROM studies_raw", "studies_raw")
    o["scan_ignore_list"] = _w("SELECT DISTINCT study_name FROM ignore_names", "ignore_names")
    o["stage_parquet"] = ("SELECT vec_id, label, CAST(pos AS BIGINT) AS pos, round(CAST(v AS DOUBLE), 9) AS val "
                          "FROM (SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, "
                          "unnest(embedding) AS v FROM embeddings)")
    o["sink_csv"] = _w(f"WITH {lrc}\n{exact_full}", "studies")
    o["sink_csv_batches"] = _w("SELECT batch, count(*) AS n, min(trait_id) AS min_trait_id, "
                               "max(trait_id) AS max_trait_id, CAST(sum(efo_id) AS BIGINT) AS sum_efo_id "
                               "FROM (SELECT *, (row_number() OVER (ORDER BY trait_id, efo_id) - 1) // 500 "
                               "AS batch FROM cand) GROUP BY batch", "cand")
    o["sink_jsonl_requests"] = _w(f"WITH {BULLETS}, {PROMPTS}, {REQUESTS}\n"
                                  "SELECT batch, custom_id, model, prompt_md5 FROM requests", "cand")
    o["scan_jsonl_responses"] = _w("SELECT json_extract_string(value, '$.custom_id') AS custom_id "
                                   "FROM llm_lines WHERE trim(value) <> ''", "llm_lines")
    o["export_curated"] = _w(f"WITH {SELECTIONS}\nSELECT * FROM selections", "cand", "sel_events",
                             "rank_options")

    # 2.2 rows
    o["filter_phenotype"] = _w("SELECT * FROM studies_raw WHERE data_type = 'phenotype' "
                               "AND source <> 'ebi_catalog'", "studies_raw")
    o["split_by_source"] = _w("SELECT study_name, source, CASE WHEN source IS NOT DISTINCT FROM 'common' "
                              "THEN 'selected' ELSE 'others' END AS part FROM studies_raw", "studies_raw")
    o["project_rename"] = _w("SELECT study_name AS study_name_rare, trait, source FROM studies", "studies")
    o["exclude_ignored"] = _w("SELECT * FROM studies_raw s WHERE NOT EXISTS (SELECT 1 FROM ignore_names i "
                              "WHERE i.study_name = s.study_name)", "studies_raw", "ignore_names")
    o["drop_non_string"] = _w("SELECT * FROM studies_raw WHERE trait IS NOT NULL", "studies_raw")
    o["type_audit"] = _w("SELECT CASE WHEN trait IS NULL THEN 'missing' ELSE 'string' END AS kind, "
                         "count(*) AS n FROM studies_raw GROUP BY 1", "studies_raw")
    o["dedupe_first"] = _w("SELECT study_name, trait, source, variant_type, data_type, sample_size, study_id "
                           "FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY study_id) AS rn "
                           "FROM studies_raw WHERE data_type = 'phenotype' AND source <> 'ebi_catalog') "
                           "WHERE rn = 1", "studies_raw")
    o["distinct_pairs"] = _w("SELECT DISTINCT trait_id, trait FROM cand", "cand")
    o["dense_row_index"] = _w("SELECT study_name, source, row_number() OVER (ORDER BY study_name) - 1 AS idx "
                              "FROM studies", "studies")
    o["contains_filter"] = "SELECT doc_id FROM documents WHERE regexp_matches(text, '[Ll]icen[cs]e')"
    o["head_n"] = _w("SELECT study_name, sample_size FROM studies ORDER BY sample_size DESC, study_name "
                     "LIMIT 10", "studies")

    # 2.3 text
    o["clean_unicode"] = f"SELECT doc_id, {trait2_sql('text')} AS text_clean FROM documents"
    o["clean_ascii"] = f"SELECT doc_id, {clean_ascii_sql('text')} AS text_clean FROM documents"
    o["strip_boilerplate"] = f"SELECT doc_id, {_strip_sql(_boiler_input_sql())} AS text_clean FROM documents"

    # 2.4 linkage
    o["link_exact"] = _w(f"WITH {lrc}\n{exact_full}", "studies")
    o["residual_anti"] = _w(f"WITH {lrc}\nSELECT * FROM l WHERE study_name_rare NOT IN "
                            f"(SELECT study_name_rare FROM ({_exact_pairs()}))", "studies")
    for key, col, p, ctes in (("link_fuzzy_jw", "trait", 0.1, lrc), ("link_fuzzy_jw_clean", "trait2", 0.1, lrc2),
                              ("link_fuzzy_jw_p15", "trait2", 0.15, lrc2)):
        cols = ["trait", "source"] + (["trait2"] if col == "trait2" else [])
        pairs = best_jw_sql("l", "r", "study_name_rare", "study_name_common", col, p, 0.05)
        o[key] = _w(f"WITH {ctes}\n" + suffixed_select(pairs, "l", "r", "study_name_rare",
                                                        "study_name_common", cols, cols,
                                                        ("_rare", "_common"), "m.dist"), "studies")
    pairs = best_wjac_sql("l", "r", "study_name_rare", "study_name_common", "trait2", 0.2, "source")
    o["link_weighted_jaccard"] = _w(f"WITH {lrc2}\n" + suffixed_select(
        pairs, "l", "r", "study_name_rare", "study_name_common", ["trait", "source", "trait2"],
        ["trait", "source", "trait2"], ("_rare", "_common"), "m.dist"), "studies")

    docs = (f"dl AS (SELECT doc_id AS doc_id_left, {trait2_sql('text')} AS text_clean FROM documents "
            f"WHERE doc_id % 4 <> 1), dr AS (SELECT doc_id AS doc_id_right, {trait2_sql('text')} AS text_clean "
            f"FROM documents WHERE doc_id % 4 = 1)")
    o["link_weighted_jaccard_docs"] = (f"WITH {docs}\n" + best_wjac_sql(
        "dl", "dr", "doc_id_left", "doc_id_right", "text_clean", 0.2, None))

    def lr0(sources, lk="study_name_rare", rk="study_name_common", right_sources=("common",),
            right_variant="common", extra=""):
        src = ", ".join(_q(s) for s in sources)
        rsrc = ", ".join(_q(s) for s in right_sources)
        return (f"{PHENO},\nl0 AS (SELECT study_name AS {lk}, trait, source{extra} FROM pheno WHERE source IN ({src}) "
                f"AND variant_type = 'rare_exome')",
                f"r0 AS (SELECT study_name AS {rk}, trait, source{extra} FROM pheno WHERE source IN ({rsrc}) "
                f"AND variant_type = {_q(right_variant)})")

    lcte, rcte = lr0(("rare_a",))
    o["link_cascade"] = _w(cascade_sql(lcte, rcte, "study_name_rare", "study_name_common",
                                       ["trait", "source"], ("_rare", "_common"), block="source"), "studies")
    lcte, rcte = lr0(("rare_a", "rare_b", "rare_c"))
    o["link_many_sources"] = _w(cascade_sql(lcte, rcte, "study_name_rare", "study_name_common",
                                            ["trait", "source"], ("_rare", "_common"), block="source"),
                                "studies")
    lcte, rcte = lr0(("rare_a",), "study_name1", "study_name2", ("rare_b",), "rare_exome", ", sample_size")
    o["link_rare_rare"] = _w(cascade_sql(lcte, rcte, "study_name1", "study_name2",
                                         ["trait", "source", "sample_size"], ("_1", "_2"),
                                         STEPS[:4], block="source"), "studies")
    o["reattach_ids"] = _w(f"WITH {PARSED}\nSELECT p.custom_id, p.trait, p.efo, p.confidence, i.trait_id "
                           "FROM parsed p LEFT JOIN (SELECT trait_id, min_by(trait, efo_id) AS t FROM cand GROUP BY trait_id) i "
                           "ON p.trait IS NOT DISTINCT FROM i.t WHERE p.parsed", "cand", "llm_lines")

    # 2.5 vectors
    o["embed_terms"] = ("WITH terms AS (SELECT text, min(doc_id) AS term_id FROM documents WHERE text IS NOT NULL "
                        "GROUP BY text), toks AS (SELECT term_id, unnest(regexp_split_to_array(text, '\\s+')) AS tok "
                        "FROM terms), per AS (SELECT term_id, CAST(CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) "
                        "% 64 AS BIGINT) AS dim, count(*) AS n FROM toks WHERE tok <> '' GROUP BY 1, 2) "
                        "SELECT term_id, dim, round(n / sum(n) OVER (PARTITION BY term_id), 9) AS val FROM per")
    o["cosine_one_to_all"] = ("WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
                              "q AS (SELECT id AS qid, v AS qv FROM e WHERE id = (SELECT min(id) FROM e)) "
                              f"SELECT qid AS query_id, e.id AS other_id, round({cos_sql('e.v', 'qv')}, 9) "
                              "AS similarity FROM e JOIN q ON e.id <> q.qid")
    o["topk_cross_partition"] = _topk("label = 0", "label <> 0", 30, "trait_id", "other_id")
    o["topk_candidates"] = _topk("label < 5", "label >= 5", 20, "trait_id", "efo_id")
    o["dedupe_candidates"] = ("WITH t AS (" + _topk("label < 5", "label >= 5", 20, "trait_id", "term_row") +
                              ") SELECT trait_id, efo_id, term_row, similarity, rank FROM ("
                              "SELECT *, term_row % 100 AS efo_id, row_number() OVER (PARTITION BY trait_id, "
                              "term_row % 100 ORDER BY similarity DESC, term_row) AS rn FROM t) WHERE rn = 1")

    def bucket(tok):
        return f"CAST(CAST(('0x' || substr(md5({tok}), 1, 8)) AS BIGINT) % 64 AS BIGINT)"

    def vec_ctes(name, src, id_col, text_col):
        return (f"{name}_rep AS (SELECT {text_col} AS txt, min({id_col}) AS rep FROM {src} "
                f"WHERE {text_col} IS NOT NULL GROUP BY {text_col}),\n"
                f"{name}_dim AS (SELECT rep, {bucket('tok')} AS dim, count(*) AS n FROM (SELECT rep, "
                f"unnest(regexp_split_to_array(txt, '\\s+')) AS tok FROM {name}_rep) WHERE tok <> '' "
                f"GROUP BY 1, 2),\n"
                f"{name}_vec AS (SELECT rep, dim, n / sum(n) OVER (PARTITION BY rep) AS v "
                f"FROM {name}_dim),\n"
                f"{name}_nrm AS (SELECT rep, sqrt(sum(v * v)) AS nrm FROM {name}_vec GROUP BY rep)")

    st = ("st0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY study_id) AS rn "
          "FROM studies_raw WHERE data_type = 'phenotype') WHERE rn = 1),\n"
          "st AS (SELECT *, " + _strip_sql("trait") + " AS trait_clean FROM st0 s WHERE trait IS NOT NULL "
          "AND NOT EXISTS (SELECT 1 FROM ignore_names i WHERE i.study_name = s.study_name))")
    o["map_traits_to_terms"] = _w(
        f"WITH {st},\n{vec_ctes('t', 'st', 'study_id', 'trait_clean')},\n{vec_ctes('o', 'onto', 'id', 'term')},\n"
        "dots AS (SELECT t.rep AS trep, o.rep AS orep, sum(t.v * o.v) AS dot FROM t_vec t JOIN o_vec o "
        "USING (dim) GROUP BY 1, 2),\n"
        "terms AS (SELECT onto.id, onto.term, r.rep AS orep FROM onto JOIN o_rep r ON r.txt = onto.term),\n"
        "sizes AS (SELECT orep, count(*) AS n FROM terms GROUP BY orep),\n"
        # texts that fewer than 20 ids of better texts precede: no other can be among the best 20
        "sims AS (SELECT * FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY trep ORDER BY similarity DESC "
        "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before FROM (SELECT tn.rep AS trep, "
        "onm.rep AS orep, sizes.n, round(CASE WHEN tn.nrm = 0 OR onm.nrm = 0 THEN 0.0 ELSE coalesce(d.dot, 0.0) / "
        "(tn.nrm * onm.nrm) END, 9) AS similarity FROM t_nrm tn JOIN o_nrm onm ON true JOIN sizes ON sizes.orep = onm.rep "
        "LEFT JOIN dots d ON d.trep = tn.rep AND d.orep = onm.rep)) WHERE before < 20),\n"
        "top AS (SELECT * FROM (SELECT trep, terms.id AS efo_id, terms.term AS efo, similarity, row_number() OVER "
        "(PARTITION BY trep ORDER BY similarity DESC, terms.id) AS rank FROM sims JOIN terms USING (orep)) WHERE rank <= 20)\n"
        "SELECT st.study_name AS trait_id, st.trait, top.efo, top.efo_id, top.similarity, top.rank "
        "FROM st JOIN t_rep r ON r.txt = st.trait_clean JOIN top ON top.trep = r.rep",
        "studies_raw", "ignore_names", "onto")

    # 2.6 LLM
    o["candidate_bullets"] = _w(f"WITH {BULLETS}\nSELECT trait, bullets FROM bullets", "cand")
    o["build_prompts"] = _w(f"WITH {BULLETS}, {PROMPTS}\nSELECT trait, first_id, prompt FROM prompts", "cand")
    def field(x):
        return (f"CASE WHEN regexp_matches({x}, '[\",\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' "
                f"ELSE coalesce({x}, '') END")

    o["few_shot_prompt"] = _w(
        f"WITH {SELECTIONS},\nknown AS (SELECT trait, selected_efo_id AS k, selected_efo || CASE WHEN selected_efo_id % 5 = 0 "
        "THEN ', not otherwise specified' ELSE '' END AS efo FROM (SELECT *, row_number() OVER (PARTITION BY selected_efo_id "
        "ORDER BY trait_id) AS rn FROM selections WHERE selected_efo IS NOT NULL) WHERE rn = 1),\n"
        f"shown AS (SELECT c.trait_id, string_agg({NL} || {field('known.trait')} || ',' || {field('known.efo')}, '' ORDER BY k) AS lines "
        "FROM (SELECT DISTINCT trait_id, efo_id FROM cand) c JOIN known ON k = c.efo_id GROUP BY c.trait_id)\n"
        f"SELECT s.trait_id, 'Known mappings:' || {NL} || 'trait,efo' || coalesce(lines, '') || {NL} || {NL} || 'Map the trait \"' || "
        "s.trait || '\" in the same way.' AS prompt FROM selections s LEFT JOIN shown USING (trait_id) "
        "WHERE s.selected_efo IS NULL", "cand", "sel_events", "rank_options")
    for key, wording in (("build_prompts_trait_trait", WORDING_TRAIT), ("build_prompts_local", WORDING_LOCAL)):
        o[key] = _w(f"WITH {BULLETS}, {prompts_sql(wording)}\nSELECT trait, first_id, prompt FROM prompts", "cand")
    o["parse_trait_trait"] = _w(f"WITH {PARSED}\nSELECT custom_id, trait, efo AS match, confidence, parsed FROM parsed", "llm_lines")
    o["answers_to_csv"] = _w(
        f"WITH {PARSED}\nSELECT i.trait_id, p.trait, p.efo, p.confidence, p.efo IN (SELECT term FROM onto) AS valid FROM parsed p "
        "LEFT JOIN (SELECT trait_id, min_by(trait, efo_id) AS t FROM cand GROUP BY trait_id) i "
        "ON p.trait IS NOT DISTINCT FROM i.t WHERE p.parsed", "cand", "llm_lines", "onto")
    o["topk_string_ids"] = (_topk("label < 5", "label >= 5", 20, "trait_id", "efo_id")
                            .replace("SELECT vec_id AS id", "SELECT 'S' || vec_id AS id", 1)
                            .replace("SELECT vec_id AS id", "SELECT 'EFO:' || vec_id AS id", 1))
    o["build_requests"] = _w(f"WITH {BULLETS}, {PROMPTS}, {REQUESTS}\n"
                             "SELECT idx, batch, custom_id, model, max_tokens, prompt_md5 FROM requests", "cand")
    o["parse_llm_response"] = _w(f"WITH {PARSED}\nSELECT custom_id, trait, efo, confidence, parsed FROM parsed",
                                 "llm_lines")
    o["extract_json_line"] = _w(f"WITH {FREE_PARSED}\nSELECT trait_id, trait, efo, confidence, parsed "
                                "FROM free_parsed", "llm_free")
    o["quarantine_bad_answers"] = _w(
        f"WITH {PARSED}\nSELECT CASE WHEN parsed THEN 'kept' ELSE 'quarantined' END AS status, "
        "CASE WHEN NOT parsed THEN 'unparseable' WHEN confidence_raw IS NOT NULL AND confidence IS NULL "
        "THEN 'non_numeric_confidence' END AS reason, count(*) AS n FROM parsed GROUP BY 1, 2", "llm_lines")
    o["stack_answers"] = _w(
        f"WITH {PARSED}, {FREE_PARSED}\n"
        "SELECT custom_id, trait, efo, confidence, 'batch' AS origin FROM parsed WHERE parsed "
        "UNION ALL SELECT NULL AS custom_id, trait, efo, confidence, 'local' AS origin FROM free_parsed "
        "WHERE parsed", "llm_lines", "llm_free")
    o["confidence_counts"] = _w(f"WITH {PARSED}\nSELECT confidence, count(*) AS n FROM parsed "
                                "WHERE confidence IS NOT NULL GROUP BY confidence", "llm_lines")
    o["validate_terms"] = _w(f"WITH {PARSED}\nSELECT p.custom_id, p.efo, t.term IS NOT NULL AS valid "
                             "FROM (SELECT * FROM parsed WHERE parsed) p LEFT JOIN (SELECT DISTINCT term FROM onto "
                             "WHERE term IS NOT NULL) t ON p.efo = t.term", "llm_lines", "onto")
    o["answer_coverage"] = _w(f"WITH {PARSED}\nSELECT a.n_asked, b.n_answered, CASE WHEN a.n_asked > 0 THEN "
                              "round(b.n_answered / a.n_asked, 9) END AS coverage FROM "
                              "(SELECT count(DISTINCT trait) AS n_asked FROM cand) a, "
                              "(SELECT count(DISTINCT trait) AS n_answered FROM parsed WHERE parsed) b",
                              "llm_lines", "cand")
    o["token_cost"] = _w(
        f"WITH {BULLETS}, {PROMPTS}\nSELECT n_requests, input_tokens, round(input_tokens / 1e6 * 1.25, 9) "
        "AS input_cost, n_requests * 30 AS output_tokens, round(n_requests * 30 / 1e6 * 5.0, 9) AS output_cost "
        "FROM (SELECT count(*) AS n_requests, CAST(coalesce(sum(len(list_filter(regexp_split_to_array(prompt, "
        "'\\s+'), lambda t: t <> ''))), 0) AS BIGINT) AS input_tokens FROM prompts)", "cand")

    # 2.7 summaries
    o["count_by_kind"] = _w("SELECT data_type, variant_type, source, count(*) AS n FROM studies_raw "
                            "WHERE data_type = 'phenotype' GROUP BY data_type, variant_type, source", "studies_raw")
    o["value_counts"] = _w("SELECT source, count(*) AS n FROM studies_raw WHERE data_type = 'phenotype' "
                           "AND source IS NOT NULL GROUP BY source", "studies_raw")
    cols = ["study_name", "trait", "source", "variant_type", "data_type", "sample_size", "study_id"]
    o["frame_profile"] = _w(" UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, "
        f"count(DISTINCT {c}) AS n_distinct, CAST({len(cols)} AS BIGINT) AS n_columns FROM studies_raw"
        for i, c in enumerate(cols)), "studies_raw")

    # 2.8 curation
    o["rank_options"] = _w("SELECT * FROM rank_options", "rank_options")
    o["similarity_label"] = _w(
        "SELECT trait_id, efo_id, CAST(CAST(round_even(similarity * 100, 0) AS BIGINT) AS VARCHAR) || '%' "
        "AS label, regexp_replace(CAST(round_even(similarity * 100, 1) AS VARCHAR), '\\.0+$', '') || '%' AS label_detail "
        "FROM cand", "cand")
    o["resolve_rank_choice"] = _w("SELECT e.trait_id, e.rank, e.event_id, e.ts, o.efo, o.efo_id, o.similarity "
                                  "FROM sel_events e JOIN rank_options o ON o.trait_id = e.trait_id "
                                  "AND o.rank = e.rank", "sel_events", "rank_options")
    o["latest_selection"] = o["export_curated"]
    o["latest_selection_stream"] = o["export_curated"]
    o["selection_status"] = _w(f"WITH {SELECTIONS}\nSELECT *, CASE WHEN selected_efo IS NULL THEN 'Pending' "
                               "ELSE 'Completed' END AS status FROM selections", "cand", "sel_events",
                               "rank_options")
    o["curation_progress"] = _w(
        f"WITH {SELECTIONS}\nSELECT completed, total, CASE WHEN total > 0 THEN round(100.0 * completed / total, 9) "
        "END AS percent, CAST(completed AS VARCHAR) || ' of ' || CAST(total AS VARCHAR) || ' traits curated' "
        "AS text FROM (SELECT count(selected_efo) AS completed, count(*) AS total FROM selections)",
        "cand", "sel_events", "rank_options")
    o["next_uncurated"] = _w(
        f"WITH {SELECTIONS}\nSELECT worklist, trait_id, coalesce(min(CASE WHEN selected_efo IS NULL THEN trait_id END) "
        "OVER (PARTITION BY worklist ORDER BY trait_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), "
        "min(CASE WHEN selected_efo IS NULL THEN trait_id END) OVER (PARTITION BY worklist)) AS next_trait_id "
        "FROM (SELECT *, trait_id % 10 AS worklist FROM selections)", "cand", "sel_events", "rank_options")

    o["next_uncurated_string_ids"] = _w(
        f"WITH {SELECTIONS}\nSELECT worklist, trait_id, coalesce(min(p) OVER (PARTITION BY worklist ORDER BY trait_id "
        "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(p) OVER (PARTITION BY worklist)) AS next_trait_id "
        "FROM (SELECT 'EFO:' || trait_id AS trait_id, CASE WHEN selected_efo IS NULL THEN 'EFO:' || trait_id END AS p, "
        "CAST(trait_id % 3 AS VARCHAR) AS worklist FROM selections)", "cand", "sel_events", "rank_options")

    # 2.9 training
    pairs_where = "WHERE phenotype IS NOT NULL AND efo_term IS NOT NULL"
    o["training_pairs"] = _w(f"SELECT DISTINCT trait AS phenotype, efo AS efo_term FROM rank_options "
                             f"WHERE rank = 1 AND trait IS NOT NULL AND efo IS NOT NULL", "rank_options")
    expand = f"SELECT DISTINCT phenotype, efo_term FROM (SELECT unnest(synonyms) AS phenotype, term AS efo_term FROM onto_syn) {pairs_where}"
    o["expand_synonyms"] = _w(expand, "onto_syn")
    o["training_prompt"] = _w(f"SELECT phenotype, efo_term, 'Map the following phenotype to its EFO term:' || {NL} || "
                              f"'Phenotype: ' || phenotype || {NL} || 'EFO Term: ' || efo_term AS text FROM ({expand})",
                              "onto_syn")
    o["parent_synonyms"] = (f"SELECT DISTINCT phenotype, efo_term FROM (SELECT unnest([r_name, lower(r_name)]) AS phenotype, "
                            f"n_name AS efo_term FROM nation JOIN region ON n_regionkey = r_regionkey) {pairs_where}")
    o["hierarchy_pairs"] = (f"SELECT DISTINCT n_name AS phenotype, r_name AS efo_term FROM nation JOIN region "
                            f"ON n_regionkey = r_regionkey WHERE n_name IS NOT NULL AND r_name IS NOT NULL")
    o["lexicon_synonyms"] = _w(
        "WITH lex AS (SELECT * FROM (VALUES ('small', 'little'), ('red', 'crimson'), ('blue', 'azure')) v(word, synonym)), "
        "w AS (SELECT term, string_split(term, ' ') AS ws FROM onto WHERE term IS NOT NULL), "
        "x AS (SELECT term, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w) "
        "SELECT DISTINCT array_to_string(ws[1:pos - 1] || [synonym] || ws[pos + 1:], ' ') AS phenotype, "
        "term AS efo_term FROM x JOIN lex ON ws[pos] = lex.word", "onto")
    o["bracket_noise"] = _w("SELECT DISTINCT term || ' (' || substr(md5(concat_ws('|', term, CAST(k AS VARCHAR), '7')), 1, 6) "
                            "|| ')' AS phenotype, term AS efo_term FROM onto, range(1, 3) AS r(k) WHERE term IS NOT NULL",
                            "onto")
    return o


ORACLE: dict[str, str] = build()
