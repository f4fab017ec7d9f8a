"""Composite flows on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.operators import retrieval as R
from docketeer.operators import workspace as W
from docketeer.plans.registry import query
from docketeer.plans.retrieval import CHUNKS, FB, QVEC, SIM, chunks, query_vector
from docketeer.sources.tables import feedback, table


@query("RET-05 SRC-11 SRC-12 UDF-06")
def ingestion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files of several types."""
    ending = F.element_at(F.array(F.lit(".pdf"), F.lit(".png"), F.lit(".zip")), (F.col("doc_id") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), ending).alias("path"), "text")
    return W.ingestion(files)


@query("RET-02 RET-03 UDF-02", f"""WITH {CHUNKS}, {QVEC}, {FB}, top AS (SELECT id, doc_id, chunk_type, text, {SIM} FROM chunks, q WHERE source_type = 'en' ORDER BY score DESC, id LIMIT 20),
near AS (SELECT * FROM fb, q WHERE collection = 'c0' AND round(list_cosine_similarity(q_vec, v), 9) >= 0.8),
s AS (SELECT doc_id, round((count_if(label = 1) + 1)::DOUBLE / (count(*) + 2), 9) AS fs FROM (SELECT unnest(doc_ids) AS doc_id, label FROM near) GROUP BY doc_id),
b AS (SELECT t.id, t.doc_id, chunk_type, score, least(length(text) / 1000.0::DOUBLE, 1.0::DOUBLE) AS rerank_score, coalesce(fs, 0.5::DOUBLE) AS feedback_score FROM top t LEFT JOIN s USING (doc_id))
SELECT *, round(0.45::DOUBLE * score + 0.35::DOUBLE * rerank_score + 0.1::DOUBLE * feedback_score + 0.1::DOUBLE * feedback_score, 9) AS final_score FROM b WHERE final_score >= 0.4 ORDER BY final_score DESC, id LIMIT 10""")
def workspace_answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.answer_context(chunks(spark, sf_dir), query_vector(spark, sf_dir), feedback(spark, sf_dir), "c0", source_type="en")


@query("RET-06 SET-04", f"""WITH {CHUNKS}, {QVEC}, i AS (SELECT id, {SIM} FROM chunks, q WHERE file_id = 'src3' ORDER BY score DESC, id LIMIT 3),
w AS (SELECT page_id AS id, round(1.0::DOUBLE / (page_id + 1), 9) AS score FROM pages)
SELECT id, score, source_no, row_number() OVER (ORDER BY source_no, score DESC, id) AS place FROM (SELECT id, score, 0 AS source_no FROM i UNION ALL SELECT id, score, 1 FROM w WHERE (SELECT count(*) FROM i) < 5) ORDER BY place LIMIT 8""")
def precedent_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    internal = R.vector_top_k(chunks(spark, sf_dir), query_vector(spark, sf_dir), 3, file_id="src3").select("id", "score")
    web = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.round(1 / (F.col("page_id") + 1), 9).alias("score"))
    return W.precedents(internal, web, 8)


@query("RET-07 STR-15 JOIN-13 SORT-15", """WITH c AS (SELECT item_id AS id, lower(left(text, 60)) AS a FROM benchmark ORDER BY item_id LIMIT 7),
h AS (SELECT c.id, min(doc_id) AS d FROM c JOIN documents ON contains(lower(text), trim(a)) GROUP BY c.id) SELECT c.id, d IS NOT NULL AS supported, 'doc/' || d AS url FROM c LEFT JOIN h USING (id)""")
def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first benchmark passages as quoted claims, looked for in the documents."""
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.replace("text", F.lit('"'), F.lit("")).alias("text"), F.lit("quote").alias("kind"))
    evidence = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("body"))
    return W.verified(claims, evidence)


@query("STR-64 FLT-18")
def candidate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four hundred term candidates of the English documents."""
    return W.candidate_terms(table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("page"), "text"))


@query("RET-10 AGG-19", """SELECT doc_id AS id, 2::BIGINT AS n, CASE WHEN doc_id % 2 = 0 THEN '(2001) 5 SCC ' || doc_id ELSE '' END AS unverified FROM documents""")
def draft_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as drafts with two citations, of which the tools' results hold one or both."""
    key = F.col("doc_id").cast("string")
    own = F.concat(F.lit("(2001) 5 SCC "), key)
    draft = F.concat("text", F.lit("; see "), own, F.lit(" and AIR 2002 SC "), key)
    corpus = F.concat("text", F.lit("; AIR 2002 SC "), key, F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit(" "), own)))
    return W.grounding(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), draft.alias("draft"), corpus.alias("corpus")))


@query("CHK-13", "SELECT conv_id AS \"group\", turn, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3)::BIGINT AS batch FROM conversations")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.batches(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group"), "turn"), "turn", 3)


def embedded(docs: DataFrame) -> DataFrame:
    """Whole texts and their stand-in embeddings."""
    return docs.select("text", W.hash_embedding(F.col("text")).alias("v"))


@query("UDF-01", "SELECT count(*) AS n, count(DISTINCT text) AS texts FROM documents")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in embeddings of all documents; equal texts must agree."""
    rows = embedded(table(spark, sf_dir, "documents"))
    per = rows.groupBy(F.sha2("text", 256).alias("t")).agg(F.count("*").alias("n"), F.count_distinct("v").alias("vectors"))
    return per.agg(F.sum("n").alias("n"), F.sum("vectors").alias("texts"))
