"""Trait → vocabulary mapping, the embedding route of the reference:

studies → data type filter → first study per trait → ignore list → non-null
→ boilerplate stripped → one vector per distinct cleaned trait and per term
→ exact top-k terms per trait → best row per (trait, term id).

Filter order is semantic and kept: the first study per trait is chosen
*before* the ignore list is applied (so a trait whose first study is ignored
is dropped). The candidates feed :func:`build_prompts` / :func:`build_requests`.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlink.functions.text import strip_boilerplate
from termlink.operators.rows import dedupe_first, drop_non_string, exclude_ignored, group_row_index
from termlink.operators.vectors import dedupe_candidates, distinct_texts, embed_terms, fits_whole, topk_cosine
from termlink.session import cut_lineage, staging_path
from termlink.sources.files import stage_parquet


_FEW = 200_000                  # names that are sent to all tasks
_TEXT_BYTES = 64 << 20          # of term texts that are


def prepare_traits(studies: DataFrame, ignore: DataFrame, order_col: str = "study_id") -> DataFrame:
    # by data type alone: this route also takes studies of any source, and of none
    st = studies.where(F.col("data_type") == "phenotype")
    if ignore.limit(_FEW + 1).count() <= _FEW:
        ignore = F.broadcast(ignore)
    st = dedupe_first(st, "trait", order_col)
    st = exclude_ignored(st, ignore)
    st = drop_non_string(st, "trait")
    return st.withColumn("trait_clean", strip_boilerplate(F.col("trait")))


def first_ids(terms: DataFrame, k: int) -> DataFrame:
    """``terms``: (id, text key columns __h, __n) → (b_id, id): the ``k`` smallest ids of each text, which is named by its smallest."""
    reps = terms.groupBy("__h", "__n").agg(F.min("id").alias("b_id"))
    few = group_row_index(terms.join(reps, ["__h", "__n"]).select("b_id", "id"), ["b_id"], ["id"], "nth").where(F.col("nth") < k)
    return cut_lineage(few.select("b_id", "id"))


def expand_terms(top: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """``top``: (a_id, b_id, similarity, rank) over distinct term texts, named by their smallest
    id. ``terms``: (id, text key columns __h, __n). → (a_id, id, similarity, rank) over all ids.

    The k best ids of a trait lie in its k best texts (each of which has an id before
    any id of a worse text), and among the k smallest ids of a text. A text that k ids or more
    of better texts precede has none of them, and is dropped before ids are attached."""
    few = first_ids(terms, k)
    held = few.groupBy("b_id").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("a_id").orderBy(F.col("similarity").desc())       # with the ids of equally good texts
    before = F.sum("n").over(upto) - F.sum("n").over(Window.partitionBy("a_id", "similarity"))
    near = (top.select("a_id", "b_id", "similarity").join(held, "b_id").withColumn("before", before)
            .where(F.col("before") < k).select("a_id", "b_id", "similarity"))
    w = Window.partitionBy("a_id").orderBy(F.col("similarity").desc(), F.col("id"))     # k * k rows at most
    return (near.join(few, "b_id")
            .withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
            .select("a_id", "id", "similarity", "rank"))


def map_traits_to_terms(studies: DataFrame, ignore: DataFrame, onto: DataFrame, k: int = 20,
                        encoder: Callable[[pd.Series], np.ndarray] | None = None, dim: int = 64,
                        order_col: str = "study_id") -> DataFrame:
    """→ (trait_id, trait, efo, efo_id, similarity, rank). ``onto`` has
    ``id`` (any type) and ``term``; studies carry an ``order_col`` that is unique.

    Each distinct term text is embedded and scored once, and fans out to every term id with that text. If every
    task can hold the vocabulary, studies are scored where they lie (:func:`_in_place`); beyond, and with a
    caller's encoder, each distinct cleaned trait is embedded and scored once and fans out to its studies."""
    # only what is needed, as Parquet: the prepared traits feed several branches
    st = prepare_traits(studies.select(*dict.fromkeys(["study_name", "trait", "data_type", order_col])), ignore, order_col)
    st = stage_parquet(st.drop("data_type"), staging_path(st.sparkSession, "traits"))
    ov = cut_lineage(embed_terms(onto, "id", "term", encoder, dim))
    terms = onto.where(F.col("term").isNotNull()).select("id", F.md5("term").alias("__h"), F.length("term").alias("__n"))
    if encoder is None:
        few = first_ids(terms, k)
        texts = distinct_texts(onto, "id", "term").select(F.col("id").alias("b_id"), F.col("text").alias("efo"))
        named = ov.groupBy("id").count().where(F.col("count") > 1).isEmpty()        # texts that share their smallest id can't be told apart
        if named and fits_whole(ov, few) and (texts.agg(F.sum(F.octet_length("efo"))).first()[0] or 0) <= _TEXT_BYTES:
            return _in_place(st, ov, few, texts, k, dim)
    tv = cut_lineage(embed_terms(st, order_col, "trait_clean", encoder, dim))
    top = topk_cosine(tv.select(F.col(order_col).alias("id"), "vec"), ov, k)
    best = expand_terms(top, terms, k)
    keyed = st.select("study_name", "trait", F.col(order_col).alias("__id"),
                      F.md5("trait_clean").alias("__h"), F.length("trait_clean").alias("__n"))
    reps = keyed.groupBy("__h", "__n").agg(F.min("__id").alias("a_id"))
    cand = (keyed.join(reps, ["__h", "__n"]).join(best, "a_id")
            .join(onto.select("id", F.col("term").alias("efo")), "id")
            .select(F.col("study_name").alias("trait_id"), "trait", "efo",
                    F.col("id").alias("efo_id"), "similarity", "rank"))
    return dedupe_candidates(cand, ("trait_id", "efo_id"), "similarity", "rank")


def _in_place(st: DataFrame, ov: DataFrame, few: DataFrame, texts: DataFrame, k: int, dim: int) -> DataFrame:
    """Candidates of vocabularies that every task can hold: a study's vector, its best terms, their ids and texts are
    found where the study lies, so no vector and no candidate goes through a shuffle. Candidates of a study name
    that stands on several rows are deduped; others have an id once."""
    names = cut_lineage(st.groupBy("study_name").count().where((F.col("count") > 1) | F.col("study_name").isNull()).select("study_name"))

    def found(rows: DataFrame) -> DataFrame:
        a = embed_terms(rows, "study_name", "trait_clean", dim=dim, keep=["study_name", "trait"])
        top = topk_cosine(a.select(F.struct("study_name", "trait").alias("id"), "vec"), ov, k, copies=few)
        return (top.join(F.broadcast(texts), "b_id")
                .select(F.col("a_id.study_name").alias("trait_id"), F.col("id").alias("efo_id"), F.col("a_id.trait").alias("trait"),
                        "efo", "similarity", "rank"))

    if names.isEmpty():
        return found(st)
    same = F.col("study_name").eqNullSafe(F.col("__again"))
    again = names.withColumnRenamed("study_name", "__again")
    return found(st.join(again, same, "left_anti")).unionByName(dedupe_candidates(
        found(st.join(again, same, "left_semi")), ("trait_id", "efo_id"), "similarity", "rank"))
