"""Training-set preparation: pairs, prompt text, augmentation.

Model training itself is out of scope; these build the (phenotype,
efo_term) table a trainer would read. Augmentations are joins and array
expressions; the noise is deterministic (md5 of term, copy number, seed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the text a training example is rendered into.
TRAINING_TEMPLATE_PARTS = ("Map the following phenotype to its EFO term:\nPhenotype: ",
                           "\nEFO Term: ")


def training_pairs(df: DataFrame, phenotype: str = "phenotype", term: str = "efo_term") -> DataFrame:
    return (df.select(F.col(phenotype).alias("phenotype"), F.col(term).alias("efo_term"))
            .where(F.col("phenotype").isNotNull() & F.col("efo_term").isNotNull()).distinct())


def training_prompt(pairs: DataFrame) -> DataFrame:
    a, b = TRAINING_TEMPLATE_PARTS
    return pairs.withColumn("text", F.concat(F.lit(a), F.col("phenotype"), F.lit(b), F.col("efo_term")))


def expand_synonyms(onto_syn: DataFrame, term: str = "term", synonyms: str = "synonyms") -> DataFrame:
    """One (phenotype = synonym, efo_term = term) pair per synonym."""
    return training_pairs(onto_syn.select(F.explode(synonyms).alias("phenotype"),
                                          F.col(term).alias("efo_term")))


def hierarchy_pairs(child: DataFrame, parent: DataFrame, child_parent_key: str, parent_key: str,
                    child_term: str, parent_term: str) -> DataFrame:
    """One-hop child → parent pairs (phenotype = child term, efo_term = parent)."""
    j = child.join(parent, child[child_parent_key] == parent[parent_key])
    return training_pairs(j.select(child[child_term].alias("phenotype"),
                                   parent[parent_term].alias("efo_term")))


def parent_synonyms(child: DataFrame, parent: DataFrame, child_parent_key: str, parent_key: str,
                    child_term: str, parent_synonyms_col: str) -> DataFrame:
    """The parent's synonyms become extra inputs for the child term."""
    j = child.join(parent, child[child_parent_key] == parent[parent_key])
    return training_pairs(j.select(F.explode(parent[parent_synonyms_col]).alias("phenotype"),
                                   child[child_term].alias("efo_term")))


def lexicon_synonyms(terms: DataFrame, lexicon: DataFrame, term: str = "term",
                     word: str = "word", synonym: str = "synonym") -> DataFrame:
    """A variant per (term, position) whose word has a lexicon synonym, with
    that one word replaced. The lexicon is a table joined on the word."""
    words = terms.select(F.col(term).alias("efo_term"), F.split(F.col(term), " ").alias("__w"))
    exploded = words.select("efo_term", "__w", F.posexplode("__w").alias("__pos", "__word"))
    hit = exploded.join(lexicon.select(F.col(word).alias("__word"), F.col(synonym).alias("__syn")),
                        "__word")
    variant = F.array_join(F.transform("__w", lambda w, i: F.when(i == F.col("__pos"), F.col("__syn"))
                                       .otherwise(w)), " ")
    return training_pairs(hit.select(variant.alias("phenotype"), "efo_term"))


def bracket_noise(terms: DataFrame, term: str = "term", copies: int = 2, seed: int = 0) -> DataFrame:
    """``term (xxxxxx)`` synonyms with a deterministic 6-character tag."""
    k = F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("__k")
    t = terms.select(F.col(term).alias("efo_term"), k)
    tag = F.substring(F.md5(F.concat_ws("|", F.col("efo_term"), F.col("__k").cast("string"),
                                        F.lit(str(seed)))), 1, 6)
    return training_pairs(t.select(F.concat(F.col("efo_term"), F.lit(" ("), tag, F.lit(")"))
                                   .alias("phenotype"), "efo_term"))
