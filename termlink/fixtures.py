"""Views over the given test tables (see FIXTURES.md), in Spark and in SQL.

Each Spark builder has a DuckDB twin in :data:`SQL_VIEWS` so the oracle
queries in ``__spark_entry__`` can be written against the same names.
The modulo expressions below *assign attribute values* (source, data type,
synthetic answer variants); none of them filters rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers reserved per document for its sentences' study ids.
STUDY_ID_STEP = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """A given table. ``partitions``: deal its rows out anew before row-wise
    work, for a table that lies in fewer splits than there are cores."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.repartition(partitions) if partitions else df


def _source(doc_id: Column) -> Column:
    m = doc_id % 4
    return (F.when(m == 0, "rare_a").when(m == 1, "common")
            .when(m == 2, "rare_b").otherwise("rare_c"))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One study per sentence of every document, in all languages: the trait is
    the whole sentence; the document's number and the sentence's place in it
    are the key."""
    d = table(spark, sf_dir, "documents")
    src = _source(F.col("doc_id"))
    sentences = d.select("doc_id", "n_chars", F.posexplode(F.split("text", r"[.!?\n]+")).alias("pos", "part"))
    s = sentences.select("doc_id", "n_chars", "pos", F.trim("part").alias("trait")).where(F.col("trait") != "")
    return s.select(
        F.concat(F.lit("S"), F.col("doc_id").cast("string"), F.lit("_"), F.col("pos").cast("string")).alias("study_name"),
        "trait",
        src.alias("source"),
        F.when(src == "common", "common").otherwise("rare_exome").alias("variant_type"),
        F.when(F.col("doc_id") % 10 == 9, "molecular").otherwise("phenotype").alias("data_type"),
        F.col("n_chars").alias("sample_size"),
        (F.col("doc_id") * STUDY_ID_STEP + F.col("pos")).alias("study_id"),
    )


def studies_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = studies(spark, sf_dir)
    i = F.col("study_id")
    return (s.withColumn("trait", F.when(i % 50 == 7, F.lit(None).cast("string")).otherwise(F.col("trait")))
             .withColumn("source", F.when(i % 97 == 3, F.lit(None).cast("string")).otherwise(F.col("source"))))


def ignore_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence's study of each toxic document."""
    return (table(spark, sf_dir, "labels").where(F.col("toxic") == 1)
            .select(F.concat(F.lit("S"), F.col("doc_id").cast("string"), F.lit("_0")).alias("study_name")))


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    # copies go before the join and by the tables' own columns, of which all others are functions
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name").distinct()
    return (li.join(p, li.l_partkey == p.p_partkey)
              .select(F.col("l_orderkey").alias("trait_id"),
                      F.concat(F.lit("trait "), F.col("l_orderkey").cast("string")).alias("trait"),
                      F.col("p_name").alias("efo"),
                      F.col("l_partkey").alias("efo_id"),
                      ((F.col("l_partkey") % 128).cast("double") / F.lit(128.0)).alias("similarity")))


def onto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"),
                                               F.col("p_name").alias("term"))


def onto_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"),
                    F.array(F.col("p_name"),
                            F.concat_ws(" ", F.col("p_brand"), F.col("p_type"))).alias("synonyms"))


def sel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return e.select(F.col("event_id"), F.col("ts"), F.col("user_id").alias("trait_id"),
                    F.when(k % 10 == 0, F.lit(10)).otherwise(k % 10).alias("rank"))


def traits_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "embeddings").where(F.col("label") < 5)
            .select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


def onto_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "embeddings").where(F.col("label") >= 5)
            .select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


def llm_content(trait: Column, efo: Column, trait_id: Column) -> Column:
    """The synthetic answer text for one trait (FIXTURES.md §2, LLM answers)."""
    efo = F.when(trait_id % 7 == 0, F.lit("made up term")).otherwise(efo)
    numeric = F.to_json(F.struct(trait.alias("trait"), efo.alias("efo"),
                                 (trait_id % 5 + 1).alias("confidence")))
    wordy = F.to_json(F.struct(trait.alias("trait"), efo.alias("efo"),
                               F.lit("high").alias("confidence")))
    content = F.when(trait_id % 11 == 0, wordy).otherwise(numeric)
    # truncated answer: cut before the second comma, so the object never closes
    return F.when(trait_id % 13 == 0, F.substring_index(content, ",", 2)).otherwise(content)


def first_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each trait (rank 1), by one aggregate."""
    best = F.min_by(F.struct("trait", "efo", "efo_id"),
                    F.struct(-F.round("similarity", 9), F.col("efo_id"), F.col("efo")))
    return cand(spark, sf_dir).groupBy("trait_id").agg(best.alias("o")).select("trait_id", "o.*")


def llm_answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch-output JSON line per ``cand`` trait, from its rank-1 option."""
    top = first_options(spark, sf_dir)
    tid = F.col("trait_id")
    content = llm_content(F.col("trait"), F.col("efo"), tid)
    # every third answer comes with white space around it, as models send it
    content = F.when(tid % 3 == 0, F.concat(F.lit("\n "), content, F.lit(" \n"))).otherwise(content)
    envelope = F.to_json(F.struct(
        F.concat(F.lit("req-"), tid.cast("string")).alias("custom_id"),
        F.struct(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message")))
                          .alias("choices")).alias("body")).alias("response")))
    return top.select(tid, F.when(tid % 17 == 0, F.lit("")).otherwise(envelope).alias("value"))


def llm_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text model output: a sentence line, the JSON line, a sentence line."""
    top = first_options(spark, sf_dir)
    tid = F.col("trait_id")
    content = llm_content(F.col("trait"), F.col("efo"), tid)
    return top.select(tid, F.concat(F.lit("Thinking about "), F.col("trait"), F.lit(".\n"),
                                    content, F.lit("\nDone.")).alias("response"))


# ---------------------------------------------------------------------------
# DuckDB twins (used as CTEs by the oracle SQL)
# ---------------------------------------------------------------------------

SQL_VIEWS: dict[str, str] = {
    "studies": f"""
        SELECT 'S' || doc_id || '_' || pos AS study_name, trait,
               CASE doc_id % 4 WHEN 0 THEN 'rare_a' WHEN 1 THEN 'common'
                               WHEN 2 THEN 'rare_b' ELSE 'rare_c' END AS source,
               CASE WHEN doc_id % 4 = 1 THEN 'common' ELSE 'rare_exome' END AS variant_type,
               CASE WHEN doc_id % 10 = 9 THEN 'molecular' ELSE 'phenotype' END AS data_type,
               n_chars AS sample_size, doc_id * {STUDY_ID_STEP} + pos AS study_id
        FROM (SELECT doc_id, n_chars, pos, trim(part, ' ') AS trait
              FROM (SELECT doc_id, n_chars, unnest(parts) AS part, unnest(range(len(parts))) AS pos
                    FROM (SELECT doc_id, n_chars, regexp_split_to_array(text, '[.!?\\n]+') AS parts FROM documents)))
        WHERE trait <> ''""",
    "studies_raw": """
        SELECT study_name,
               CASE WHEN study_id % 50 = 7 THEN NULL ELSE trait END AS trait,
               CASE WHEN study_id % 97 = 3 THEN NULL ELSE source END AS source,
               variant_type, data_type, sample_size, study_id
        FROM studies""",
    "ignore_names": "SELECT 'S' || doc_id || '_0' AS study_name FROM labels WHERE toxic = 1",
    "cand": """
        SELECT DISTINCT l_orderkey AS trait_id, 'trait ' || l_orderkey AS trait,
               p_name AS efo, l_partkey AS efo_id,
               CAST(l_partkey % 128 AS DOUBLE) / 128.0 AS similarity
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "onto": "SELECT p_partkey AS id, p_name AS term FROM part",
    "onto_syn": """SELECT p_partkey AS id, p_name AS term,
                          [p_name, concat_ws(' ', p_brand, p_type)] AS synonyms FROM part""",
    "sel_events": """
        SELECT event_id, ts, user_id AS trait_id,
               CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 THEN 10
                    ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 END AS rank
        FROM events WHERE event_type = 'purchase'""",
    "traits_vec": "SELECT vec_id AS id, embedding AS vec FROM embeddings WHERE label < 5",
    "onto_vec": "SELECT vec_id AS id, embedding AS vec FROM embeddings WHERE label >= 5",
    "rank_options": """
        SELECT trait_id, trait, efo, efo_id, similarity,
               row_number() OVER (PARTITION BY trait_id
                                  ORDER BY round(similarity, 9) DESC, efo_id, efo) AS rank
        FROM cand WHERE trait_id IS NOT NULL""",
    "llm_lines": """
        SELECT trait_id,
               CASE WHEN trait_id % 17 = 0 THEN ''
               ELSE json_object('custom_id', 'req-' || trait_id,
                       'response', json_object('body', json_object('choices', json_array(
                          json_object('message', json_object('content',
                            CASE WHEN trait_id % 3 = 0 THEN chr(10) || ' ' || cut || ' ' || chr(10)
                                 ELSE cut END)))))) ::VARCHAR END AS value
        FROM (SELECT trait_id, CASE WHEN trait_id % 13 = 0 THEN array_to_string((string_split(c, ','))[1:2], ',')
                                    ELSE c END AS cut FROM (SELECT trait_id, trait,
                     CASE WHEN trait_id % 11 = 0 THEN
                          json_object('trait', trait, 'efo', e, 'confidence', 'high')::VARCHAR
                          ELSE json_object('trait', trait, 'efo', e,
                                           'confidence', trait_id % 5 + 1)::VARCHAR END AS c
              FROM (SELECT trait_id, trait,
                           CASE WHEN trait_id % 7 = 0 THEN 'made up term' ELSE efo END AS e
                    FROM rank_options WHERE rank = 1)))""",
    "llm_free": """
        SELECT trait_id, 'Thinking about ' || trait || '.' || chr(10) ||
               CASE WHEN trait_id % 13 = 0 THEN array_to_string((string_split(c, ','))[1:2], ',')
                    ELSE c END || chr(10) || 'Done.' AS response
        FROM (SELECT trait_id, trait,
                     CASE WHEN trait_id % 11 = 0 THEN
                          json_object('trait', trait, 'efo', e, 'confidence', 'high')::VARCHAR
                          ELSE json_object('trait', trait, 'efo', e,
                                           'confidence', trait_id % 5 + 1)::VARCHAR END AS c
              FROM (SELECT trait_id, trait,
                           CASE WHEN trait_id % 7 = 0 THEN 'made up term' ELSE efo END AS e
                    FROM rank_options WHERE rank = 1))""",
}

# dependency order for assembling a WITH clause
_ORDER = ["studies", "studies_raw", "ignore_names", "cand", "onto", "onto_syn", "sel_events",
          "traits_vec", "onto_vec", "rank_options", "llm_lines", "llm_free"]
_DEPS = {"studies_raw": ["studies"], "rank_options": ["cand"],
         "llm_lines": ["rank_options"], "llm_free": ["rank_options"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with a WITH clause defining the named views (and deps)."""
    need: set[str] = set()

    def add(n):
        if n in need:
            return
        for d in _DEPS.get(n, []):
            add(d)
        need.add(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in _ORDER if n in need)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
