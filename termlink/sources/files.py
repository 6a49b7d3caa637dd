"""Sources and sinks: delimited text, name lists, JSON lines,
parquet staging, batched outputs.

Readers take an explicit schema (no inference); every delimited column is
read as text and one null list is applied, so the same bytes give the same
table whatever engine wrote them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlink.operators.rows import dense_row_index
from termlink.session import cut_lineage

NULL_TOKENS = ("", "NA")


def scan_delimited(spark: SparkSession, path: str, columns: Sequence[str] | T.StructType,
                   sep: str = "\t", header: bool = True,
                   null_tokens: Sequence[str] = NULL_TOKENS, multi_line: bool = False,
                   line_sep: str | None = None) -> DataFrame:
    """Header CSV/TSV with declared columns. ``columns`` is either names
    (read as strings) or a StructType whose types are applied after the
    null list with ``try_cast``-style casts.

    ``multi_line``: fields may hold line breaks; a file is then read by one task,
    otherwise a large one by many. ``line_sep``: only this ends a line (by default ``\\r`` does, too, even
    within a field)."""
    if isinstance(columns, T.StructType):
        names, types = [f.name for f in columns], [f.dataType for f in columns]
    else:
        names, types = list(columns), [T.StringType()] * len(columns)
    raw_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = (spark.read.schema(raw_schema).option("header", header).option("sep", sep)
          .option("multiLine", multi_line).option("quote", '"').option("escape", '"')
          .option("nullValue", "\u0000").option("emptyValue", "").options(**({"lineSep": line_sep} if line_sep else {}))
          .csv(path))
    out = []
    for n, t in zip(names, types):
        c = F.when(F.col(n).isin(list(null_tokens)), F.lit(None)).otherwise(F.col(n))
        out.append((c if isinstance(t, T.StringType) else c.try_cast(t)).alias(n))
    return df.select(out)


def sink_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Header CSV, no row index; nulls written as empty fields."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("quote", '"')
     .option("escape", '"').option("emptyValue", '""')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def scan_ignore_list(spark: SparkSession, path: str, column: str = "study_name") -> DataFrame:
    """One name per line: trimmed, empty lines dropped, duplicates removed."""
    return (spark.read.text(path).select(F.trim(F.col("value")).alias(column))
            .where(F.col(column) != "").distinct())


def stage_parquet(df: DataFrame, path: str) -> DataFrame:
    """Persist an intermediate table (vectors as array columns) and read it
    back, which also cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_batches(df: DataFrame, order: Sequence[str], batch_size: int) -> DataFrame:
    """Dense index in ``order`` and ``batch = index // batch_size``."""
    idx = dense_row_index(df, list(order), "__idx")
    return idx.withColumn("batch", (F.col("__idx") / F.lit(batch_size)).cast("long"))


def sink_csv_batches(df: DataFrame, path: str, order: Sequence[str], batch_size: int = 500) -> None:
    """Fixed-size CSV parts in row order, one folder of one file per batch number
    (``batch=<n>``). No trailing empty part.

    ``df`` is worked out once: its rows are dealt by ranges of ``order`` and stored. The rows of a batch that lies in one
    range are written from where they are; only batches on the edge of two ranges (one a range at most) meet in
    a shuffle. Files are put in place by the tasks that write them, not by the driver one after the other."""
    spark, size = df.sparkSession, F.lit(batch_size)
    order = list(order)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                       .withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id()))
    # one row a range
    per = rows.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__pid", "__n", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
                     F.sum("__n").over(Window.partitionBy()).alias("__all"))
    b = (rows.join(F.broadcast(per), "__pid").withColumn("__idx", F.col("__off") + F.col("__mid") - F.col("__first"))
         .withColumn("batch", F.expr(f"__idx div {int(batch_size)}")))
    whole = ((F.col("batch") * size >= F.col("__off"))
             & (F.least((F.col("batch") + 1) * size, F.col("__all")) <= F.col("__off") + F.col("__n")))
    kept = [*df.columns, "batch", "__idx"]
    (b.where(whole).select(*kept).unionByName(b.where(~whole).select(*kept).repartition("batch"))
     .sortWithinPartitions("batch", "__idx").drop("__idx")
     .write.mode("overwrite").partitionBy("batch").option("header", True)
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(path))


def sink_jsonl_requests(requests: DataFrame, path: str, batch_size: int = 1000,
                        order: Sequence[str] = ("idx",)) -> None:
    """Request lines (column ``request``) into one JSON-lines folder per batch."""
    b = requests if "batch" in requests.columns else with_batches(requests, order, batch_size)
    sort_col = "idx" if "idx" in b.columns else "__idx"
    (b.repartition("batch").sortWithinPartitions(sort_col).select("batch", F.col("request").alias("value"))
     .write.mode("overwrite").partitionBy("batch").text(path))


def scan_jsonl_responses(spark: SparkSession, path: str) -> DataFrame:
    """All JSON-lines files under ``path`` as one table of non-empty lines."""
    return spark.read.text(path).where(F.trim(F.col("value")) != "")


def export_curated(selections: DataFrame, base: str, stamp: str, fmt: str = "csv") -> str:
    """Write the selection table under ``curated_traits_<stamp>``; the
    stamp (``%Y%m%d_%H%M``) is passed in so runs are reproducible."""
    path = f"{base.rstrip('/')}/curated_traits_{stamp}"
    if fmt == "csv":
        sink_csv(selections, path)
    else:
        selections.write.mode("overwrite").parquet(path)
    return path
