"""Corpus pipeline: the stages from raw documents to packed token ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``, calls one operator of
:mod:`termlink.llm`, and its result is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.

1. quality: a classifier fitted on ``labels`` rejects low-quality documents
   (op6's model and limit).
2. near_duplicates: one document of each SimHash class stays, the one
   with the smallest doc_id (3-word shingles, 2 bits, as op5).
3. decontamination: documents that share a window of 10 words with a benchmark item go.
4. mixing: sources are drawn to their target weights in whole documents.  A document
   taken twice is two rows; rows come by shard, shuffled in it.
5. packing: token ids in rows of 2048, as op1.

Tables without rows pass through; null texts are empty ones (they score like any
empty text, are copies of each other, and have no words to mix or pack).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from termlink.llm import decontaminate, mixing, packing, quality, simhash
from termlink.llm.queries import VOCABULARY_RANKS
from termlink.llm.tables import staged, table

#: No SQL: hashed features, XXH64 votes and a vocabulary aren't expressible in it.
#: tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), reject_below=0.7)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, shingle=3, max_bits=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_documents(docs, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0, whole_documents=True)
    return mixed.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(VOCABULARY_RANKS), public_tokenizers.PATTERN, length=2048)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
