"""Filters, projections and row identity.

Everything is a declarative DataFrame operation so Catalyst can push
filters into the parquet scan and prune columns. No operator here sends a
whole group through one task: "first row per key" is an aggregate with
partial (map-side) combine, and the dense index is computed per range
partition plus a per-partition offset table whose size is the partition count.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlink.session import cut_lineage


def _cols(cols) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def filter_phenotype(df: DataFrame, variant_type: str | None = None,
                     excluded_source: str = "ebi_catalog") -> DataFrame:
    """``data_type == 'phenotype' & source != excluded`` (+ variant type).

    Like R's ``subset``, a row whose condition is NULL (e.g. null source) is
    dropped — Spark's ``filter`` has the same three-valued semantics.
    """
    cond = (F.col("data_type") == "phenotype") & (F.col("source") != excluded_source)
    if variant_type is not None:
        cond = cond & (F.col("variant_type") == variant_type)
    return df.filter(cond)


def split_by_source(df: DataFrame, source: str, col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows of one source and *all other* rows; null sources go to the others."""
    c = F.col(col)
    return df.filter(c.eqNullSafe(source)), df.filter(~c.eqNullSafe(source))


def project_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select and rename: ``{"study_name": "study_name_rare", "trait": "trait"}``."""
    return df.select([F.col(src).alias(dst) for src, dst in mapping.items()])


def exclude_ignored(df: DataFrame, ignore: DataFrame, key: str = "study_name",
                    ignore_key: str | None = None) -> DataFrame:
    """Drop rows whose key is listed; null keys are kept (``%in%`` semantics).

    A left-anti join, never ``NOT IN`` (which would drop everything once the
    list holds a null). The list is not force-broadcast: AQE turns the join
    into a broadcast at run time only when the list's measured size is small.
    """
    ig = ignore.select(F.col(ignore_key or key).alias("__ig")).where(F.col("__ig").isNotNull())
    return df.join(ig, F.col(key) == F.col("__ig"), "left_anti")


def drop_non_string(df: DataFrame, col: str = "trait") -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def type_audit(df: DataFrame, col: str = "trait") -> DataFrame:
    kind = F.when(F.col(col).isNull(), "missing").otherwise("string")
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def dedupe_first(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str) -> DataFrame:
    """Keep the first row per key in the given order; a null key is a value.

    Written as ``min_by`` over a struct, which is combined in the map tasks: a
    key holding a third of all rows leaves one row in each instead of being sorted in
    one place. (A sort aggregate, since rows may hold strings.)
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    ordkey = F.struct(*[F.col(c) for c in order])
    first = df.groupBy(*keys).agg(F.min_by(packed, ordkey).alias("__row"))
    return first.select(*[F.col(k) for k in keys],
                        *[F.col(f"__row.{c}").alias(c) for c in others]).select(*df.columns)


def distinct_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def dense_row_index(df: DataFrame, order: Sequence[str] | str, index_col: str = "idx",
                    num_partitions: int | None = None) -> DataFrame:
    """Contiguous 0-based position in a total order, without a one-partition sort.

    1. range-partition the distinct order keys (bounds from sampling) and sort inside
       each partition; tag them with partition id and a monotonically
       increasing id; pin that layout with a reliable checkpoint (keys only,
       no payload) so both passes below see the same rows in the same places;
    2. count rows per partition (one row per partition) and turn the counts
       into offsets — that table's size is the partition count, so it is
       safe to broadcast;
    3. index = partition offset + position inside the partition, joined back
       to the rows by key.
    ``order`` must be a total order (add a unique tie-break column).
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(order)])
    names = keys.columns
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(n, *names).sortWithinPartitions(*names)
    tagged = cut_lineage(ordered.withColumn("__pid", F.spark_partition_id())
                         .withColumn("__mid", F.monotonically_increasing_id()))
    per_part = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"),
                                           F.min("__mid").alias("__first"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    placed = tagged.join(F.broadcast(offsets.select("__pid", "__off", "__first")), "__pid").select(
        *names, (F.col("__off") + F.col("__mid") - F.col("__first")).cast("long").alias(index_col))
    cond = [df[c].eqNullSafe(placed[k]) for c, k in zip(order, names)]
    return df.join(placed, cond).select(*[df[c] for c in df.columns], placed[index_col])


def contains_filter(df: DataFrame, col: str, pattern: str, regex: bool = True) -> DataFrame:
    c = F.col(col)
    return df.filter(c.rlike(pattern) if regex else c.contains(pattern))


def head_n(df: DataFrame, n: int, order: Iterable) -> DataFrame:
    """First ``n`` rows in an order: planned as TakeOrderedAndProject."""
    return df.orderBy(*_cols(list(order))).limit(n)


def group_row_index(df: DataFrame, group: Sequence[str], order: Sequence, index_col: str = "idx",
                    start: int = 0, num_partitions: int | None = None) -> DataFrame:
    """Position of each row inside its group (``row_number`` semantics, from
    ``start``) without sending a group through one task.

    Range partitioning on (group, order) splits even a group holding a third
    of all rows across many partitions; per (partition, group) row counts
    turn into offsets with a window over that small table (at most one row
    per partition for each group). Null group values form their own group.
    """
    group = list(group)
    keys = [F.col(c) for c in group] + _cols(list(order))
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    tagged = cut_lineage(ordered.withColumn("__pid", F.spark_partition_id())
                         .withColumn("__mid", F.monotonically_increasing_id()))
    per = tagged.groupBy("__pid", *group).agg(F.count(F.lit(1)).alias("__n"),
                                              F.min("__mid").alias("__first"))
    w = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    offs = offs.select("__pid", *[F.col(g).alias(f"__g_{g}") for g in group], "__off", "__first")
    cond = [tagged["__pid"] == offs["__pid"]] + [tagged[g].eqNullSafe(offs[f"__g_{g}"]) for g in group]
    out = tagged.join(offs, cond).select(
        *[tagged[c] for c in df.columns],
        (offs["__off"] + tagged["__mid"] - offs["__first"] + F.lit(start)).cast("long").alias(index_col))
    return out
