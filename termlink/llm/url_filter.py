"""URL filter: rules first, then a tree of path templates judged by labels.

Everything here is DataFrame work (no Python in tasks).

The distinct (host, path) pairs are walked segment by segment from the root of each
host.  At each node:

* *generalise*: a child segment with a digit is variable if it has a sibling; another
  one is if it holds less than ``min_share`` of the node's URLs and the node has at
  least ``min_children`` children.  Variable segments become wildcards by shape (digits ``0``, letters ``a``, other
  characters themselves: ``742.html`` is ``{0.a}``), unless their labels speak against it: a labelled
  child whose bad rate differs from that of its wildcard's children together keeps its name.  The test
  is the likelihood ratio (twice, chi-square) against ``z`` squared plus twice the logarithm of the number of
  labelled children, for so many are tested and many have a label or two;
* *merge*: of the remaining children, those whose labelled bad rate doesn't differ
  from that of all of them together by more than ``z`` standard errors become one
  branch ``+``; children that do differ keep their names.

The path's template is the sequence of these tokens.  A template's purity is its
bad rate among labelled URLs, smoothed by ``strength`` pseudo-labels at its host's
rate, which is smoothed likewise at the rate of all.  Templates whose purity
reaches ``reject_at`` are blocked, all others allowed, also those without labels.

A rule (host, path) fits its host and all subdomains where the URL's path starts
with the rule's path.  The longest rule that fits decides alone.

Edge cases: a null URL and one without ``://`` have empty host and path and fall in
the template of that; duplicates of a URL get the same verdict; labels of URLs
that no page has are ignored, null labels too; paths of any depth are walked to their end (a level is a
round, beyond ``_WHOLE_LEVELS`` only for paths that still have something to be told apart from); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlink.llm.tables import staged

Rule = tuple[str, str, str]

#: A node's figures are joined to its children under so many keys, so that the children of
#: one node, a host with most of all pages, say, are spread over so many tasks.
_SALTS = 32

#: Levels that are walked with all paths; after those, paths that are settled are set aside.
_WHOLE_LEVELS = 8


def _under_salts(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest fitting rule (verdict, host, path), else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    s = F.regexp_replace(segment, r"[0-9]+", "0")
    return F.concat(F.lit("{"), F.regexp_replace(s, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "a"), F.lit("}"))


def _stands_out(n: Column, bad: Column, all_n: Column, all_bad: Column, tested: Column, z: float) -> Column:
    """Whether ``bad`` of ``n`` labels are too many or too few at the rate ``all_bad / all_n``."""
    def part(k: Column, of_all: Column) -> Column:
        return F.when(k > 0, k * F.log(k / n * all_n / of_all)).otherwise(F.lit(0.0))

    return 2 * (part(bad, all_bad) + part(n - bad, all_n - all_bad)) > z * z + 2 * F.log(tested)


def _unsettled(p: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """``(open, settled)``: paths whose node has different rests of paths, and all others with
    their whole template.  Equal rests have one child at each level, which is a branch ``+``."""
    rest = F.array_join(F.slice("segments", depth + 1, 1 << 30), "/")
    more = F.size("segments") > depth
    node = p.where(more).groupBy("host", "template").agg((F.min(rest) != F.max(rest)).alias("open"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(_SALTS)).cast("int"))
    p = staged(p.join(_under_salts(node), ["host", "template", "salt"], "left")
               .withColumn("open", more & F.coalesce("open", F.lit(False))).drop("salt"), "url-rests")
    ends = F.concat("template", F.repeat(F.lit("/+"), F.greatest(F.lit(0), F.size("segments") - depth)))
    return p.where("open").drop("open"), p.where(~F.col("open")).withColumn("template", ends).drop("open")


def templates(paths: DataFrame, min_children: int = 8, min_share: float = 0.05, z: float = 2.0) -> DataFrame:
    """``paths``: host, path (distinct), n, n_labelled, n_bad.  Adds ``template``."""
    # "/a/b" has the segments a, b; "/a/b/" has a, b and an empty one
    segments = F.slice(F.split("path", "/"), 2, 1 << 30)
    p = paths.withColumn("segments", segments).withColumn("template", F.lit(""))
    deepest = p.agg(F.max(F.size("segments"))).first()[0] or 0
    walked = []
    for depth in range(deepest):
        if depth >= _WHOLE_LEVELS:
            p, settled = _unsettled(p, depth)
            walked.append(settled)
            if p.isEmpty():
                break
        here = p.withColumn("segment", F.get("segments", F.lit(depth)))
        child = here.where("segment is not null").groupBy("host", "template", "segment").agg(
            *[F.sum(c).alias(c) for c in ("n", "n_labelled", "n_bad")])
        node = child.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.count("*").alias("children"))
        child = child.withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(_SALTS)).cast("int"))
        child = child.join(_under_salts(node), ["host", "template", "salt"]).withColumn(
            "variable", F.when(F.col("segment").rlike("[0-9]"), F.col("children") > 1).otherwise(
                (F.col("children") >= min_children) & (F.col("n") < min_share * F.col("all_n"))))
        child = child.withColumn("shape", F.when(F.col("variable") & (F.col("n_labelled") > 0), _shape(F.col("segment"))))
        # a wildcard all of whose labels are alike, or are one child's, has none that differs
        wild = child.where("shape is not null").groupBy("host", "template", "shape").agg(
            F.count("*").alias("m"), F.sum("n_labelled").alias("wl"), F.sum("n_bad").alias("wb")).where(
            "m > 1 and wb > 0 and wb < wl")
        child = child.join(_under_salts(wild), ["host", "template", "shape", "salt"], "left").withColumn(
            "own", F.coalesce(_stands_out(F.col("n_labelled"), F.col("n_bad"), F.col("wl"), F.col("wb"), F.col("m"), z), F.lit(False)))
        kept = child.where(~F.col("variable")).groupBy("host", "template").agg(
            F.sum("n_labelled").alias("l"), F.sum("n_bad").alias("b"))
        rate = F.col("b") / F.col("l")
        spread = F.sqrt(rate * (1 - rate) * F.col("n_labelled"))
        differs = (F.col("n_labelled") > 0) & (F.abs(F.col("n_bad") - rate * F.col("n_labelled")) > z * spread)
        token = (F.when(F.col("own"), F.col("segment")).when(F.col("variable"), _shape(F.col("segment"))).when(differs, F.col("segment"))
                 .otherwise(F.lit("+")))
        child = (child.join(_under_salts(kept), ["host", "template", "salt"], "left")
                 .select("host", "template", "segment", token.alias("token")))
        p = staged(
            here.join(child, ["host", "template", "segment"], "left")
            .withColumn("template", F.concat("template", F.coalesce(F.concat(F.lit("/"), "token"), F.lit(""))))
            .drop("segment", "token"), "url-templates")
    for settled in walked:
        p = p.unionByName(settled)
    return p.drop("segments")


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], strength: float = 4.0, reject_at: float = 0.5,
          id_col: str = "page_id", url_col: str = "url", **tree) -> DataFrame:
    """One row per page: id, host, path, rule, template, purity, verdict.
    labels: ``url, bad`` (0 or 1; a URL may have several)."""
    url = F.col(url_col)
    own = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    marks = (labels.where("bad is not null").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "bad")
             .groupBy("host", "path").agg(F.count("*").alias("n_labelled"), F.sum("bad").alias("n_bad")))
    paths = staged(own.groupBy("host", "path").agg(F.count("*").alias("n")).join(marks, ["host", "path"], "left")
                   .fillna(0, ["n_labelled", "n_bad"]), "url-paths")
    shaped = templates(paths, **tree)

    def smooth(prior: Column) -> Column:
        return (F.col("n_bad") + strength * prior) / (F.col("n_labelled") + strength)

    sums = [F.sum(c).alias(c) for c in ("n_labelled", "n_bad")]
    of_all = paths.agg(((F.coalesce(F.sum("n_bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n_labelled"), F.lit(0)) + 2)).alias("p")).first()[0]
    hosts = shaped.groupBy("host").agg(*sums).select("host", smooth(F.lit(of_all)).alias("host_rate"))
    purity = (shaped.groupBy("host", "template").agg(*sums).join(hosts, "host")
              .select("host", "template", smooth(F.col("host_rate")).alias("purity")))
    verdicts = (shaped.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(_SALTS)).cast("int"))
                .join(_under_salts(purity), ["host", "template", "salt"])
                .select("host", "path", "template", "purity",
                        F.when(F.col("purity") >= reject_at, "block").otherwise("allow").alias("own")))
    rule, decided = apply_rules(F.col("host"), F.col("path"), rules)
    return (own.join(verdicts, ["host", "path"])
            .select(id_col, "host", "path", rule.alias("rule"), "template", "purity",
                    F.coalesce(decided, F.col("own")).alias("verdict")))
