"""Session construction and the shared staging folder.

Jobs cut lineage with ``DataFrame.checkpoint()`` (reliable checkpoint, never
``localCheckpoint``) or by writing a table under the folder the cluster names
in ``spark.checkpoint.dir``.  That setting is read from the session; a
folder of our own is only chosen when it is unset, which happens in tests and
in the local bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "termlink",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with the options the operators expect.

    The master, the shuffle partitions and the driver's memory are set only if
    given: on a cluster they are the submitter's. Tests and the local bench
    pass ``master="local[n]"``."""
    spark = session_builder(master, app, shuffle_partitions, extra).getOrCreate()
    if master is not None:
        spark.sparkContext.setLogLevel("ERROR")
        ensure_checkpoint_dir(spark)
    return spark


def session_builder(master: str | None = None, app: str = "termlink",
                    shuffle_partitions: int | None = None,
                    extra: dict | None = None) -> SparkSession.Builder:
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "false",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master is not None and master.startswith("local"):
        conf["spark.ui.enabled"] = "false"
        conf["spark.ui.showConsoleProgress"] = "false"
        conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared staging folder, registering it as the checkpoint dir.

    Uses ``spark.checkpoint.dir`` when the cluster sets it. Only when it is
    unset *and* the master is local (tests, bench) is a scratch folder made;
    otherwise a missing folder is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception as e:  # a remote session has no context: the folder must be in its settings
        path = spark.conf.get(CHECKPOINT_CONF, None)
        if not path:
            raise RuntimeError(f"{CHECKPOINT_CONF} is not set; it must name a shared folder") from e
        return path
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        current = sc.getCheckpointDir()
        if current:
            return current
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_CONF} is not set; on a cluster it must name a shared folder")
        path = tempfile.mkdtemp(prefix="termlink-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_CONF, path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


_RUN = f"termlink-run-{uuid.uuid4().hex[:12]}"


def run_folder(spark: SparkSession) -> str:
    """The folder of this process's tables within the shared staging folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{_RUN}"


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of this run's folder for a written table."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clean_run(spark: SparkSession) -> None:
    """Delete every table this process has staged. For the end of a job: tables
    derived from staged ones can't be read any more. (Checkpoints are Spark's own;
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes those.)"""
    jvm, path = spark.sparkContext._jvm, run_folder(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as ``--py-files`` would:
    their Python workers import it by name."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="termlink-package-")), "termlink.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("termlink", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives executor
    loss, unlike ``localCheckpoint``) and return the truncated DataFrame."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
