"""Reading the input tables and writing intermediate ones.

An intermediate table is written as Parquet under the folder that
``spark.checkpoint.dir`` names, so that a lost executor costs the tasks it was
running and nothing that was finished.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from termlink.session import staging_path

#: Most rows in one Arrow batch of whole texts.  Bounds the memory of a Python
#: worker; has no influence on results.
TEXT_BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def successive(spark: SparkSession, name: str, keep: int = 2) -> Callable[[DataFrame], DataFrame]:
    """``staged`` for the rounds of a loop: only the tables of the last ``keep`` rounds stay.  A round may read
    the one before it, and nothing may read an older one."""
    paths: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        path = staging_path(spark, name)
        df.write.parquet(path)
        paths.append(path)
        if len(paths) > keep:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop(0))
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        return spark.read.schema(df.schema).parquet(path)
    return put


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when it ends: for loops whose rounds end in written tables."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def small_text_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``TEXT_BATCH_ROWS`` if it is larger
    (or unlimited), before whole texts are handed to Python workers."""
    now = int(spark.conf.get(_BATCH_CONF))
    if now <= 0 or now > TEXT_BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(TEXT_BATCH_ROWS))
