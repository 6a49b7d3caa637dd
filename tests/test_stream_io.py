"""Stream restart (exactly-once through the checkpoint) and file sinks."""

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from termlink import fixtures as fx
from termlink.operators import curation as cur
from termlink.session import staging_path
from termlink.sources import files as io
from termlink.streaming.selection import read_selection_state, start_selection_stream


def test_stream_restart_resumes_from_checkpoint(spark):
    cand = fx.cand(spark, SF_SMALL)
    options = cur.rank_options(cand)
    events_dir = staging_path(spark, "ev")
    ev = fx.sel_events(spark, SF_SMALL).withColumn("day", F.to_date("ts"))
    days = sorted(r.day for r in ev.select("day").distinct().collect())
    cut = days[len(days) // 2]
    work = staging_path(spark, "restart")
    src = f"{events_dir}/day=*"
    # first run sees only the early days, then the query ends
    ev.where(F.col("day") < cut).write.partitionBy("day").parquet(events_dir)
    q = start_selection_stream(spark, src, options, f"{work}/log", f"{work}/ckpt",
                               available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    # later days arrive; a restart on the same checkpoint must process only them
    ev.where(F.col("day") >= cut).write.mode("append").partitionBy("day").parquet(events_dir)
    q = start_selection_stream(spark, src, options, f"{work}/log", f"{work}/ckpt",
                               available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    assert q.lastProgress is not None
    got = read_selection_state(spark, f"{work}/log").toPandas().sort_values("trait_id")
    exp = (cur.latest_choice(cur.resolve_rank_choice(fx.sel_events(spark, SF_SMALL), options))
           .toPandas().sort_values("trait_id"))
    pd.testing.assert_frame_equal(got.reset_index(drop=True)[sorted(got.columns)],
                                  exp.reset_index(drop=True)[sorted(exp.columns)], check_dtype=False)


def test_scan_delimited_null_tokens(spark):
    path = staging_path(spark, "tsv")
    df = spark.createDataFrame([("a", "NA", "1"), ("b", "", "x"), ("c", " q ", "3")], "k string, v string, n string")
    io.sink_csv(df, path, sep="\t")
    back = io.scan_delimited(spark, path, __import__("pyspark.sql.types", fromlist=["StructType"]).StructType.fromJson(
        {"type": "struct", "fields": [{"name": "k", "type": "string", "nullable": True, "metadata": {}},
                                      {"name": "v", "type": "string", "nullable": True, "metadata": {}},
                                      {"name": "n", "type": "long", "nullable": True, "metadata": {}}]}), sep="\t")
    rows = {r.k: (r.v, r.n) for r in back.collect()}
    assert rows == {"a": (None, 1), "b": (None, None), "c": (" q ", 3)}


def test_csv_batches_are_full_and_ordered(spark):
    path = staging_path(spark, "batches")
    df = spark.range(0, 1234).select(F.col("id").alias("k"))
    io.sink_csv_batches(df, path, ["k"], 500)
    back = spark.read.option("header", True).schema("k long, batch long").csv(path)
    per = {r.batch: (r.n, r.lo, r.hi) for r in
           back.groupBy("batch").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()}
    assert per == {0: (500, 0, 499), 1: (500, 500, 999), 2: (234, 1000, 1233)}


def test_a_large_delimited_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "big.tsv"
    with path.open("w") as f:
        f.write("k\tv\n" + "".join(f"{i}\tvalue {i}\n" for i in range(200_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        df = io.scan_delimited(spark, str(path), ["k", "v"])
        assert df.rdd.getNumPartitions() > 3 and df.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quoted_line_breaks_on_request(spark):
    path = staging_path(spark, "breaks")
    df = spark.createDataFrame([("a", "one\ntwo"), ("b", 'say "hi", ok')], "k string, v string")
    io.sink_csv(df, path)
    back = io.scan_delimited(spark, path, ["k", "v"], sep=",", multi_line=True)
    assert {r.k: r.v for r in back.collect()} == {"a": "one\ntwo", "b": 'say "hi", ok'}


def test_the_session_leaves_the_cluster_its_settings(monkeypatch):
    from termlink.session import session_builder
    monkeypatch.delenv("SPARK_MASTER", raising=False)
    options = session_builder()._options
    for key in ("spark.master", "spark.sql.shuffle.partitions", "spark.driver.memory", "spark.ui.enabled"):
        assert key not in options
    assert session_builder(master="local[2]", shuffle_partitions=3)._options["spark.sql.shuffle.partitions"] == "3"


def test_a_remote_session_without_a_folder_is_an_error():
    import pytest

    from termlink.session import ensure_checkpoint_dir, staging_path as path_of

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value or default

    class Remote:
        """A session without a context, as a remote one is."""

        def __init__(self, folder=None):
            self.conf = Conf(folder)

        @property
        def sparkContext(self):
            raise AttributeError("no context")

    with pytest.raises(RuntimeError):
        path_of(Remote(), "x")
    assert ensure_checkpoint_dir(Remote("s3://b/f")) == "s3://b/f" and path_of(Remote("s3://b/f"), "x").startswith("s3://b/f/")


def test_staged_tables_can_be_cleaned_up(spark, monkeypatch):
    import os

    from termlink import session
    monkeypatch.setattr(session, "_RUN", "termlink-run-test")
    path = session.staging_path(spark, "t")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file://")
    assert os.path.isdir(local) and "/termlink-run-test/" in path
    session.clean_run(spark)
    assert not os.path.exists(local)


def test_candidates_drop_copies_before_the_join(spark, tmp_path):
    from termlink import fixtures as fx
    spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6), (3, None)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(5, "a"), (5, "a"), (5, "b"), (6, None)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    df = fx.cand(spark, str(tmp_path))
    assert sorted((r.trait_id, r.efo_id, r.efo or "") for r in df.collect()) == [(1, 5, "a"), (1, 5, "b"), (2, 5, "a"), (2, 5, "b"), (2, 6, "")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_csv_batches_are_one_file_in_order_from_rows_made_once(spark):
    path = staging_path(spark, "batches_once")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    df = spark.range(20_300).select((F.col("id") * 7919 % 20_300).alias("k")).repartition(6).mapInArrow(count, "k long")
    io.sink_csv_batches(df, path, ["k"], 500)
    assert made.value <= 2 * 20_300          # once for the ranges' bounds, once for the rows
    back = (spark.read.option("header", True).schema("k long, batch long").csv(path)
            .select("k", "batch", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect())
    files = {}
    for r in sorted(back, key=lambda r: r.at):
        files.setdefault((r.batch, r.file), []).append(r.k)
    assert {b: ks for (b, _), ks in files.items()} == {b: list(range(b * 500, min(20_300, b * 500 + 500))) for b in range(41)}
    assert len(files) == 41


def test_the_csv_of_matches_has_a_line_a_member(spark, tmp_path, monkeypatch):
    from termlink.plans import registry as R
    odd = ["Same line", "NA", 'say "hi", ok', "tab\tand \\ slash", "carriage\rreturn", "ends with one\r", "caf\u00e9 \u2028 line"]
    texts = {i: "\n".join([*odd, f"only {i}"]) for i in range(80)}
    (spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars int")
     .write.parquet(str(tmp_path / "documents.parquet")))
    monkeypatch.setattr(R, "staging_path", lambda spark, name: str(tmp_path / name))
    rows = R.QUERIES["sink_csv"](spark, str(tmp_path)).collect()
    kind = {0: "rare_a", 2: "rare_b", 3: "rare_c"}
    docs = [i for i in texts if i % 10 != 9]
    read = {"NA": None}                                  # the null list of scan_delimited
    want = [(f"S{a}_{k}", read.get(t, t), kind[a % 4], f"S{b}_{k}", read.get(t, t), "common")
            for a in docs if a % 4 != 1 for b in docs if b % 4 == 1 for k, t in enumerate(odd)]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    lines = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(str(tmp_path / "matches_csv"))
             .where(~F.col("value").startswith("study_name")).count())
    assert lines == len(docs) * len(odd)                 # 7 * 72; pairs are 7 * 56 * 16
