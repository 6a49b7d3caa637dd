"""One query per numbered operator: it applies the operator with production
parameters to the whole table and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlink.llm import (alignment, decontaminate, divergence, embedding_dedup, html_text, labelled, mixing, neighbours, packing,
                          quality, simhash, token_counts, toxicity, url_filter)
from termlink.llm.tables import table


#: Vocabulary files; another file of the same kind can be given to the operators.
VOCABULARY_JSON = "byte_bpe_50k.json"
VOCABULARY_RANKS = "byte_bpe_50k.tiktoken"
VOCABULARY_PIECES = "piece_bpe_32k.model"


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY_RANKS),
                        public_tokenizers.PATTERN, length=2048)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0)
    return mixing.taken(m).select("doc_id", "size", "source_size", "target", "taken", "n_parts")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("row")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY_JSON),
                                  public_tokenizers.PATTERN)
    return n.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _scored(scores: DataFrame, least: float) -> DataFrame:
    return scores.select(F.col("k").alias("doc_id"), labelled.held_out(F.col("k")).alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.7)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url, bad``: a page shows the document whose number its path ends in, so that
    document's labels are the page's: bad is low quality or toxic."""
    number = F.regexp_extract("url", r"/(\d+)(?:/|\.html)?(?:[?#]|$)", 1)
    pages = table(spark, sf_dir, "pages").select("url", number.try_cast("long").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return (pages.where("doc_id is not null").distinct()
            .join(table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad")), "doc_id").select("url", "bad"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir), URL_RULES)
    return judged.withColumn("purity", F.round("purity", 9))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=3, top=200)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY_JSON), public_tokenizers.PATTERN,
                            public_tokenizers.path(VOCABULARY_PIECES), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_token_packing": op1_token_packing,
    "op2_source_mixing": op2_source_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_toxicity": op7_toxicity,
    "op8_html_extraction": op8_html_extraction,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_source_divergence": op11_source_divergence,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
