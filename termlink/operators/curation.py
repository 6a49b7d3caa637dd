"""Curation state as table operators.

A curator picks one option per trait; here the picks are an event table
(trait_id, rank, ts, event_id) and the state is derived from it:
options ranked per trait, choices resolved by (trait_id, rank), the last
valid choice per trait, status, progress and the next pending trait.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlink.operators.rows import group_row_index

SELECTION_COLS = ("selected_efo", "selected_efo_id", "selected_similarity")


def rank_options(cand: DataFrame, trait_id: str = "trait_id", sim: str = "similarity",
                 tiebreak: str = "efo_id") -> DataFrame:
    """Options of each trait numbered from 1 by similarity descending
    (rounded to 9 places; ties: smaller ``tiebreak``, then term). Null ids
    are dropped. Uses the distributed group index, so one trait with a huge
    option list is still split across tasks."""
    c = cand.where(F.col(trait_id).isNotNull()).withColumn("__s", F.round(F.col(sim), 9))
    ranked = group_row_index(c, [trait_id], [F.col("__s").desc(), F.col(tiebreak), F.col("efo")],
                             "rank", start=1)
    return ranked.drop("__s")


def similarity_label(sim, digits: int = 0):
    """``round(sim*100, digits)`` + "%", half to even and without trailing zeros (as R
    rounds and prints), e.g. 0.125 → 12% or, with one digit, 12.5%; 0.5 → 50%."""
    s = F.col(sim) if isinstance(sim, str) else sim
    v = F.bround(s * F.lit(100.0), digits)
    txt = v.cast("long").cast("string") if digits == 0 else F.regexp_replace(v.cast("string"), r"\.0+$", "")
    return F.concat(txt, F.lit("%"))


def resolve_rank_choice(events: DataFrame, options: DataFrame) -> DataFrame:
    """Each choice (trait_id, rank) resolves to that option; a rank beyond
    the trait's option count finds nothing and is ignored (inner join)."""
    return events.join(options.select("trait_id", "rank", "efo", "efo_id", "similarity"),
                       ["trait_id", "rank"], "inner")


def latest_choice(choices: DataFrame) -> DataFrame:
    """Last resolved choice per trait by (ts, event_id): a ``max_by``
    aggregate (partial + final), so a hot trait never sorts in one task."""
    pick = F.struct(F.col("efo").alias("selected_efo"), F.col("efo_id").alias("selected_efo_id"),
                    F.col("similarity").alias("selected_similarity"))
    agg = choices.groupBy("trait_id").agg(F.max_by(pick, F.struct("ts", "event_id")).alias("__p"))
    return agg.select("trait_id", *[F.col(f"__p.{c}").alias(c) for c in SELECTION_COLS])


def latest_selection(cand: DataFrame, events: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """One row per (trait_id, trait); selection columns null until chosen."""
    options = options if options is not None else rank_options(cand)
    traits = cand.select("trait_id", "trait").distinct()
    latest = latest_choice(resolve_rank_choice(events, options))
    return traits.join(latest, "trait_id", "left")


def selection_status(selections: DataFrame) -> DataFrame:
    return selections.withColumn(
        "status", F.when(F.col("selected_efo").isNull(), "Pending").otherwise("Completed"))


def curation_progress(selections: DataFrame) -> DataFrame:
    agg = selections.agg(F.count("selected_efo").alias("completed"), F.count(F.lit(1)).alias("total"))
    pct = F.when(F.col("total") > 0, F.round(F.lit(100.0) * F.col("completed") / F.col("total"), 9))
    return agg.select("completed", "total", pct.alias("percent"),
                      F.concat(F.col("completed").cast("string"), F.lit(" of "),
                               F.col("total").cast("string"), F.lit(" traits curated")).alias("text"))


def next_uncurated(selections: DataFrame, worklist: str = "worklist", key: str = "trait_id",
                   chunk: int = 1 << 12) -> DataFrame:
    """For each trait of a worklist: the next pending trait after it (by
    ``key``, of any type with an order), else the worklist's first pending trait
    (possibly itself), else null → (worklist, key, next_<key>).

    Two-level scan so no worklist is sorted in one task: traits are numbered in their
    worklist by the distributed group index and cut into chunks of ``chunk`` consecutive
    numbers; a window finds the next pending one inside the chunk, and a window over
    the table of chunks (``chunk`` times smaller) the first one of the following chunks.
    """
    base = (group_row_index(selections.select(worklist, key, F.col("selected_efo").isNull().alias("__pend")),
                            [worklist], [key], "__n")
            .withColumn("__chunk", F.floor(F.col("__n") / F.lit(chunk)))
            .withColumn("__p", F.when(F.col("__pend"), F.struct(F.col("__n").alias("n"), F.col(key).alias("k")))))
    # "those after me" as a running frame over the reversed order: Spark
    # evaluates an unbounded-preceding frame incrementally, whereas a
    # "1 following .. unbounded following" frame is recomputed per row.
    after = Window.partitionBy(worklist, "__chunk").orderBy(F.col("__n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inner = base.withColumn("__in", F.min("__p").over(after))
    later = Window.partitionBy(worklist).orderBy(F.col("__chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    chunks = (base.groupBy(worklist, "__chunk").agg(F.min("__p").alias("__cmin"))
              .withColumn("__later", F.min("__cmin").over(later))
              .withColumn("__first", F.min("__cmin").over(Window.partitionBy(worklist)))
              .select(F.col(worklist).alias("__w"), F.col("__chunk").alias("__c"), "__later", "__first"))
    out = inner.join(chunks, inner[worklist].eqNullSafe(F.col("__w")) & (F.col("__chunk") == F.col("__c")))
    return out.select(worklist, key, F.coalesce("__in", "__later", "__first")["k"].alias(f"next_{key}"))
