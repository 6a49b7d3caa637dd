"""Language-model batch preparation and tolerant answer parsing.

Only data preparation and parsing is done here — no model is called. All
steps are column expressions (``concat``, ``to_json``, ``from_json``,
``try_cast``); per-trait text is built by an aggregate whose group is one
trait's candidate list.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlink.operators.rows import dedupe_first, dense_row_index

# Prompt wordings. Placeholders: {trait} = the trait text,
# {bullets} = the candidate lines ("- term", one per line).
PROMPT_TRAIT_TERM = (
    'Match the trait "{trait}" to the best EFO term from this list:\n\n{bullets}.\n\n'
    'Return JSON: {{"trait": "{trait}", "efo": "<efo term>", "confidence":<score 1-5>}}.'
)
PROMPT_TRAIT_TRAIT = (
    'This is a term used to describe a trait that I analysed in genome-wide association study: '
    '"{trait}". These were traits used in another study listed below. Find a trait from the list '
    'below that best matches my trait.\n\n{bullets}.\n\nI do not expect an exact match, but getting '
    'something that is conceptually close will suffice. Return your answer in json format with the '
    'format {{"trait": "{trait}", "match": "<other trait>", "confidence":<score>}}, where the '
    '"confidence" field represents on a scale of 1-5 how closely the trait matches, where 1 is very '
    'loose and 5 is a perfect match.'
)
PROMPT_LOCAL = (
    'This is a term used to describe a trait that was analysed in genome-wide association study: '
    '"{trait}". Find the most appropriate EFO term for this trait from the list below. I do not '
    'expect an exact match, but getting something that is conceptually close will suffice:\n\n'
    '{bullets}\n\nWhen you find an EFO term that is conceptually close, make sure to return the exact '
    'efo term. Return your answer in json format with the format {{"trait": "{trait}", "efo": '
    '"<efo term>", "confidence":<score>}}, where the "confidence" field represents on a scale of 1-5 '
    'how closely the trait matches, where 1 is very loose and 5 is a perfect match.'
)
SYSTEM_MESSAGE = "You are a helpful assistant."
REQUEST_URL = "/v1/chat/completions"

ANSWER_SCHEMA = T.StructType([T.StructField("trait", T.StringType()),
                              T.StructField("efo", T.StringType()),
                              T.StructField("match", T.StringType()),
                              T.StructField("confidence", T.StringType())])
JSON_SPACE = " \t\n\r"
ENVELOPE_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([T.StructField("body", T.StructType([
        T.StructField("choices", T.ArrayType(T.StructType([T.StructField("message", T.StructType([
            T.StructField("content", T.StringType())]))])))]))]))])


def candidate_bullets(cand: DataFrame, trait: str = "trait", term: str = "efo",
                      sim: str = "similarity", tiebreak: str = "efo_id") -> DataFrame:
    """Per trait *text*: ``"- term"`` lines joined by newlines, similarity
    descending (ties: smaller ``tiebreak``, then term)."""
    item = F.struct((-F.col(sim)).alias("s"), F.col(tiebreak).alias("k"), F.col(term).alias("t"))
    agg = cand.groupBy(trait).agg(F.array_sort(F.collect_list(item)).alias("__l"))
    return agg.select(trait, F.array_join(F.transform("__l", lambda x: F.concat(F.lit("- "), x["t"])),
                                          "\n").alias("bullets"))


def render(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` placeholders of a template with columns (``{{``/``}}``
    are literal braces), as one ``concat`` expression."""
    parts: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{[a-z_]+\})", template):
        if not piece:
            continue
        if piece == "{{":
            parts.append(F.lit("{"))
        elif piece == "}}":
            parts.append(F.lit("}"))
        elif piece.startswith("{") and piece.endswith("}"):
            parts.append(cols[piece[1:-1]])
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def build_prompts(cand: DataFrame, template: str = PROMPT_TRAIT_TERM, trait: str = "trait",
                  term: str = "efo", sim: str = "similarity", tiebreak: str = "efo_id",
                  id_col: str = "trait_id") -> DataFrame:
    """(trait, first_id, prompt): one prompt per distinct trait text.
    ``first_id`` (smallest id carrying the text) gives a stable order."""
    bullets = candidate_bullets(cand, trait, term, sim, tiebreak)
    first = cand.groupBy(trait).agg(F.min(id_col).alias("first_id"))
    return (bullets.join(first, trait)
            .select(trait, "first_id",
                    render(template, trait=F.col(trait), bullets=F.col("bullets")).alias("prompt")))


def request_struct(custom_id: Column, prompt: Column, model: str, max_tokens: int = 1000) -> Column:
    return F.struct(
        custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(REQUEST_URL).alias("url"),
        F.struct(F.lit(model).alias("model"),
                 F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
                         F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"),
                 F.lit(max_tokens).alias("max_tokens"),
                 F.struct(F.lit("json_object").alias("type")).alias("response_format")).alias("body"))


def build_requests(prompts: DataFrame, model: str = "gpt-4o-mini-2024-07-18", prefix: str = "req-",
                   max_tokens: int = 1000, batch_size: int = 1000,
                   order: Sequence[str] = ("first_id", "trait")) -> DataFrame:
    """Request envelope per prompt: ``custom_id = prefix + index`` (dense,
    0-based, in ``order``), JSON body; ``batch = index // batch_size``."""
    idx = dense_row_index(prompts, list(order), "idx")
    cid = F.concat(F.lit(prefix), F.col("idx").cast("string"))
    return idx.select("idx", (F.col("idx") / F.lit(batch_size)).cast("long").alias("batch"),
                      cid.alias("custom_id"), "trait", "prompt",
                      F.to_json(request_struct(cid, F.col("prompt"), model, max_tokens)).alias("request"))


def parse_llm_response(lines: DataFrame, value: str = "value") -> DataFrame:
    """Batch-output lines → (custom_id, content, trait, efo, confidence_raw,
    confidence). Two ``from_json`` passes: the envelope, then the answer text
    inside it. Unparseable content gives null fields (PERMISSIVE)."""
    env = F.from_json(F.col(value), ENVELOPE_SCHEMA)
    first = F.try_element_at(env["response"]["body"]["choices"], F.lit(1))   # null if no choice
    content = first["message"]["content"]
    parsed = lines.where(F.length(F.col(value)) > 0).select(
        env["custom_id"].alias("custom_id"), content.alias("content"))
    return _answer_columns(parsed, "content")


def _answer_columns(df: DataFrame, content: str) -> DataFrame:
    """trait, efo or match, confidence of the answers; JSON's white space around one is allowed."""
    text = F.trim(F.col(content), F.lit(JSON_SPACE))
    ans = F.when(text.startswith("{"), F.from_json(text, ANSWER_SCHEMA, {"mode": "PERMISSIVE"}))
    return (df.withColumn("__a", ans)
            .withColumn("trait", F.col("__a.trait"))
            .withColumn("efo", F.col("__a.efo"))
            .withColumn("match", F.col("__a.match"))
            .withColumn("confidence_raw", F.col("__a.confidence"))
            .withColumn("confidence", F.expr("try_cast(confidence_raw AS DOUBLE)"))
            .withColumn("parsed", F.col("__a").isNotNull() & F.coalesce("__a.trait", "__a.efo", "__a.match").isNotNull())
            .drop("__a"))


def extract_json_line(df: DataFrame, text: str = "response") -> DataFrame:
    """Free-text output: keep the lines that start with ``{`` and parse them."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda l: l.startswith("{"))
    return _answer_columns(df.withColumn("content", F.array_join(lines, "\n")), "content")


def quarantine_bad_answers(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split parsed answers into (kept, quarantined), each with a ``reason``.

    Unparseable answers are quarantined; a non-numeric confidence keeps the
    answer with a null confidence (as a numeric cast would) but is flagged.
    """
    reason = (F.when(~F.col("parsed"), F.lit("unparseable"))
              .when(F.col("confidence_raw").isNotNull() & F.col("confidence").isNull(),
                    F.lit("non_numeric_confidence")))
    tagged = parsed.withColumn("reason", reason)
    return tagged.where(F.col("parsed")), tagged.where(~F.col("parsed"))


def stack_answers(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def confidence_counts(answers: DataFrame, col: str = "confidence") -> DataFrame:
    return (answers.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col)))


def validate_terms(answers: DataFrame, onto: DataFrame, answer_col: str = "efo",
                   term_col: str = "term") -> DataFrame:
    """Flag answers naming a real vocabulary term (exact string match)."""
    terms = onto.select(F.col(term_col).alias("__term")).where(F.col("__term").isNotNull()).distinct()
    return (answers.join(terms, F.col(answer_col) == F.col("__term"), "left")
            .withColumn("valid", F.col("__term").isNotNull()).drop("__term"))


def answer_coverage(answers: DataFrame, asked: DataFrame, col: str = "trait") -> DataFrame:
    """Distinct traits answered vs asked (nulls excluded) and the ratio.
    Two single-row aggregates stacked and folded — no join needed."""
    a = answers.agg(F.countDistinct(col).alias("n_answered"))
    q = asked.agg(F.countDistinct(col).alias("n_asked"))
    both = q.unionByName(a, allowMissingColumns=True).agg(
        F.max("n_asked").alias("n_asked"), F.max("n_answered").alias("n_answered"))
    return both.withColumn("coverage", F.when(F.col("n_asked") > 0,
                                              F.round(F.col("n_answered") / F.col("n_asked"), 9)))


def reattach_ids(answers: DataFrame, cand: DataFrame, trait: str = "trait",
                 id_col: str = "trait_id", order: Sequence[str] = ("efo_id",)) -> DataFrame:
    """Left-join answers to one (id, trait) row per id, the first in ``order``, by
    trait text, null-safe (a null trait meets a null trait); a trait text carried by
    several ids fans out."""
    ids = dedupe_first(cand.select(id_col, F.col(trait).alias("__t"), *order), id_col, order).select(id_col, "__t")
    return answers.join(ids, answers[trait].eqNullSafe(ids["__t"]), "left").drop("__t")


def csv_field(c: Column) -> Column:
    """A CSV field: quoted if it holds a comma, a quote or a line break, quotes doubled; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike(r'[",\r\n]'), quoted).otherwise(F.coalesce(c, F.lit("")))


def few_shot_prompts(pending: DataFrame, known: DataFrame, cand: DataFrame, id_col: str = "trait_id",
                     trait: str = "trait", term: str = "efo", term_id: str = "efo_id",
                     order: Sequence[str] = ("trait_id",)) -> DataFrame:
    """``id, prompt`` for each pending trait (id, trait): known mappings as a CSV
    table, then the question.

    Selection rule: of the known mappings (id, trait, term, term id) those whose term is
    among the pending trait's candidates are shown, one per term (the first in
    ``order``), in the order of term ids. So a prompt has as many examples as its trait has
    candidates at most, a term that many traits chose counts once, and nothing is
    collected. A trait without any such mapping gets the header alone."""
    example = dedupe_first(known.select(F.col(term_id).alias("__term"), F.col(trait).alias("__trait"),
                                        F.col(term).alias("__name"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]),
                           "__term", [f"__o{i}" for i in range(len(order))])
    shown = (pending.select(id_col).distinct().join(cand.select(id_col, F.col(term_id).alias("__term")).distinct(), id_col)
             .join(example, "__term")
             .groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(
                 F.col("__term").alias("k"), F.concat(csv_field(F.col("__trait")), F.lit(","), csv_field(F.col("__name"))).alias("line"))))
                 .alias("__l")))
    lines = F.coalesce(F.array_join(F.transform("__l", lambda x: F.concat(F.lit("\n"), x["line"])), ""), F.lit(""))
    text = F.concat(F.lit("Known mappings:\ntrait,efo"), lines, F.lit('\n\nMap the trait "'), F.col(trait),
                    F.lit('" in the same way.'))
    return pending.select(id_col, trait).distinct().join(shown, id_col, "left").select(id_col, text.alias("prompt"))


def token_cost(prompts: DataFrame, text: str = "prompt", input_price_per_m: float = 1.25,
               output_tokens_per_request: int = 30, output_price_per_m: float = 5.0,
               input_tokens_estimate: int | None = None) -> DataFrame:
    """requests × tokens / 1e6 × price, for input and output.

    Input tokens are measured (whitespace tokens of each prompt) unless a
    per-request estimate is given; output tokens are a per-request estimate.
    """
    ntok = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda t: t != F.lit("")))
    per = prompts.select((F.lit(input_tokens_estimate) if input_tokens_estimate is not None
                          else ntok).cast("long").alias("tin"))
    agg = per.agg(F.count(F.lit(1)).alias("n_requests"), F.sum("tin").cast("long").alias("input_tokens"))
    return agg.select(
        "n_requests", F.coalesce(F.col("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.round(F.coalesce(F.col("input_tokens"), F.lit(0)) / F.lit(1e6) * F.lit(input_price_per_m), 9)
        .alias("input_cost"),
        (F.col("n_requests") * F.lit(output_tokens_per_request)).cast("long").alias("output_tokens"),
        F.round(F.col("n_requests") * F.lit(output_tokens_per_request) / F.lit(1e6)
                * F.lit(output_price_per_m), 9).alias("output_cost"))
