"""Connected components of an edge table, by alternating star contraction.

Each round points every node's larger neighbours at its smallest neighbour,
then every node and its smaller neighbours at the smallest of them.  The edge
table never grows, no adjacency list is gathered in one task (the minimum is a
pre-aggregated ``groupBy``; the join back is an ordinary equi-join whose hot
keys adaptive execution splits), and each round is written to the shared
folder.  Ends when every edge points at a root: a node that is the smaller end
of an edge is then the larger end of none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlink.llm.tables import staged


def _minimum(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges``: columns a, b (one orderable type; loops, repeats and either
    direction allowed, null ends ignored).  Returns ``node, root`` for every
    node that has a neighbour and is not itself the root; root is the smallest
    node of the component."""
    e = staged(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_minimum(both), "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        low = _minimum(large)
        e = staged(
            large.join(low, "u").select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u != v").distinct(), "links")
        inner = e.select(F.col("v").alias("u")).distinct()
        many = e.groupBy("u").count().where("count > 1").select("u")
        if e.join(inner, "u", "left_semi").isEmpty() and many.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
