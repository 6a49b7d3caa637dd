"""Summaries: grouped counts, value counts, frame profile."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by_kind(df: DataFrame, keys: Sequence[str] = ("data_type", "variant_type", "source"),
                  data_type: str | None = "phenotype") -> DataFrame:
    """Rows per key combination (null groups kept), optionally among one data type."""
    src = df.where(F.col("data_type") == data_type) if data_type else df
    return src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per non-null value, most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(col)))


def frame_profile(df: DataFrame) -> DataFrame:
    """Long format (column, position, n_rows, n_null, n_distinct, n_columns), one
    row per column, also of an empty table.

    Every column is unpivoted to (column, digest of the value as a string) and counted by
    these — a partial-aggregated shuffle whatever the column count, of digests
    instead of whole values — then folded per column. No per-column job, no
    driver loop."""
    cols = df.columns
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.md5(F.col(c).cast("string")).alias("value"))
                                for i, c in enumerate(cols)])).alias("__p")
    per_value = df.select(pairs).select("__p.*").groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n"))
    found = per_value.groupBy("pos").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("n_null"),
        F.count("value").alias("n_distinct"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "pos int, `column` string")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_rows", "n_null", "n_distinct")]
    return names.join(found, "pos", "left").select("pos", "column", *counts, F.lit(len(cols)).cast("long").alias("n_columns"))
