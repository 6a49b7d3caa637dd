"""Headline-query benchmark. Prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set below), BENCH_WARM=0 to
skip the untimed warm-up pass on the smallest tables.
Each query is executed completely through the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "link_many_sources",       # flagship: 5-stage cascade, 3 rare sources
    "link_fuzzy_jw",
    "link_fuzzy_jw_p15",
    "link_weighted_jaccard",
    "link_weighted_jaccard_docs",  # same operator on whole documents
    "link_exact",
    "topk_candidates",
    "dedupe_candidates",
    "embed_terms",
    "strip_boilerplate",
    "clean_unicode",
    "dedupe_first",
    "build_requests",
    "parse_llm_response",
    "rank_options",
    "latest_selection",
    "next_uncurated",
    "map_traits_to_terms",     # embedding route end to end
]


def prune_stats(spark, sf_dir):
    """Pairs of cleaned traits that meet in a unit of the fuzzy join (not timed)."""
    from pyspark.sql import functions as F

    from termlink.operators.linkage import jw_units
    from termlink.plans import registry as R
    left = R._with_trait2(R._rare_left(spark, sf_dir)).select(F.col("trait2").alias("s")).distinct()
    right = R._with_trait2(R._common_right(spark, sf_dir)).select(F.col("trait2").alias("s")).distinct()
    n_all = left.count() * right.count()
    out = {"pairs_all": n_all}
    for p in (0.1, 0.15):
        units = jw_units(left, right, p, 0.05).groupBy("unit", "family").agg(
            F.sum(1 - F.col("side")).alias("l"), F.sum("side").alias("r"))
        out[f"pairs_compared_p{p}"] = units.agg(F.sum(F.col("l") * F.col("r"))).first()[0]
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    from termlink.plans.registry import QUERIES
    from termlink.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.range(1000).selectExpr("sum(id)").collect()   # JVM warm-up, not timed
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.environ.get("BENCH_WARM", "1") == "1" and os.path.isdir(warm_dir):
        # class loading, Python workers and code generation, on the smallest
        # tables: not timed
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": cpus}
    if os.environ.get("BENCH_PRUNE", "1") == "1":
        out["fuzzy_pruning"] = prune_stats(spark, sf_dir)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
