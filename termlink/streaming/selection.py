"""Curation state maintained as choices arrive (Structured Streaming).

Source: a folder of choice events (parquet files: event_id, ts, trait_id,
rank). Each micro-batch is resolved against the static option table
(stream-static inner join) and folded into a per-trait ``max_by`` state
(stateful aggregation, ``update`` mode). ``foreachBatch`` appends the
changed rows, tagged with the batch id, to an update log under the shared
staging folder; the current state is the newest row per trait in that log.
Checkpoint and log both live in the shared folder, so a restarted query
resumes exactly once after losing executors or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlink.operators.curation import SELECTION_COLS, resolve_rank_choice

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("trait_id", T.LongType()), T.StructField("rank", T.IntegerType())])


def start_selection_stream(spark: SparkSession, events_dir: str, options: DataFrame,
                           log_dir: str, checkpoint_dir: str, available_now: bool = True,
                           max_files_per_trigger: int | None = None):
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(events_dir)
    choices = resolve_rank_choice(events, options)
    pick = F.struct(F.col("efo").alias("selected_efo"), F.col("efo_id").alias("selected_efo_id"),
                    F.col("similarity").alias("selected_similarity"), F.col("ts"), F.col("event_id"))
    state = choices.groupBy("trait_id").agg(F.max_by(pick, F.struct("ts", "event_id")).alias("p"))

    def append(batch: DataFrame, batch_id: int) -> None:
        (batch.select("trait_id", F.lit(batch_id).cast("long").alias("batch_id"),
                      *[F.col(f"p.{c}").alias(c) for c in SELECTION_COLS])
         .write.mode("append").parquet(log_dir))

    # the log exists, with its types, from the start; reading it then needs no guess
    empty = state.select("trait_id", F.lit(0).cast("long").alias("batch_id"), *[F.col(f"p.{c}").alias(c) for c in SELECTION_COLS])
    spark.createDataFrame([], empty.schema).write.mode("append").parquet(log_dir)
    writer = (state.writeStream.outputMode("update").foreachBatch(append)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_selection_state(spark: SparkSession, log_dir: str) -> DataFrame:
    """Newest row per trait from the update log (an aggregate, no sort)."""
    log = spark.read.parquet(log_dir)
    pick = F.struct(*[F.col(c) for c in SELECTION_COLS])
    agg = log.groupBy("trait_id").agg(F.max_by(pick, F.col("batch_id")).alias("p"))
    return agg.select("trait_id", *[F.col(f"p.{c}").alias(c) for c in SELECTION_COLS])


def latest_selection_stream(spark: SparkSession, cand: DataFrame, options: DataFrame,
                            events_dir: str, work_dir: str) -> DataFrame:
    """Run the stream over everything in ``events_dir`` (availableNow) and
    return one row per trait like :func:`latest_selection`."""
    q = start_selection_stream(spark, events_dir, options, f"{work_dir}/log", f"{work_dir}/ckpt")
    q.awaitTermination()
    traits = cand.select("trait_id", "trait").distinct()
    return traits.join(read_selection_state(spark, f"{work_dir}/log"), "trait_id", "left")
