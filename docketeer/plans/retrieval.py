"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.operators import retrieval as R
from docketeer.plans.registry import query
from docketeer.sources.tables import feedback, judgments, paragraphs, table

WORDS = ["the", "of"]

CASES = """cases AS (SELECT doc_id AS id, source AS court, (1990 + doc_id % 35)::INT AS year, [lang, source] AS judges,
  CASE WHEN doc_id % 3 = 0 THEN '(' || (1990 + doc_id % 35) || ') 5 SCC ' || doc_id END AS citation, text AS body FROM documents)"""
PARAS = "paras AS (SELECT vec_id AS id, doc_id AS judgment_id, text AS body, embedding::DOUBLE[] AS embedding, label FROM documents JOIN embeddings ON doc_id = vec_id)"
QVEC = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
TOKENS = "regexp_split_to_array(lower(body), '[^a-z0-9]+')"
SCORE = " + ".join(f"len(list_filter({TOKENS}, lambda t: t = '{w}')) / (1.0::DOUBLE + len(list_filter({TOKENS}, lambda t: t = '{w}')))" for w in WORDS)
ALL_WORDS = " AND ".join(f"list_contains({TOKENS}, '{w}')" for w in WORDS)


def query_vector(spark: SparkSession, sf_dir: str, number: int = 0) -> list[float]:
    """The one vector that stands for the question."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == number).select("embedding").first()
    return list(row[0]) if row else []


def hybrid_sql(where: str, k: int) -> str:
    return f"""
WITH {CASES}, {PARAS}, {QVEC}, kept AS (SELECT * FROM cases WHERE {where}),
within AS (SELECT p.* FROM paras p WHERE p.judgment_id IN (SELECT id FROM kept)),
sem AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank_s FROM (SELECT id, round(1 - list_cosine_similarity(embedding, v), 9) AS d FROM within, q ORDER BY d, id LIMIT 100)),
lex AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank_f FROM (SELECT id, round({SCORE}, 9) AS s FROM within WHERE {ALL_WORDS} ORDER BY s DESC, id LIMIT 100)),
fused AS (SELECT coalesce(s.id, l.id) AS id, rank_s, rank_f, 0.7::DOUBLE / (60 + coalesce(rank_s, 1000)) + 0.3::DOUBLE / (60 + coalesce(rank_f, 1000)) AS rrf
  FROM sem s FULL JOIN lex l ON s.id = l.id ORDER BY rrf DESC, 1 LIMIT 50)
SELECT f.id, p.judgment_id, c.court, c.year, c.citation, rank_s, rank_f, round(CASE WHEN c.citation <> '' THEN rrf + 0.05::DOUBLE ELSE rrf END, 9) AS score
FROM fused f JOIN paras p ON f.id = p.id JOIN kept c ON p.judgment_id = c.id ORDER BY score DESC, f.id LIMIT {k}"""


@query("RET-01 FLT-01 MATH-01 MATH-03 MATH-04 MATH-06 WIN-01 WIN-02 JOIN-01 JOIN-02 JOIN-03 SORT-01 SORT-02 SORT-03 SORT-04", hybrid_sql("year >= 1995", 20))
def hybrid_search_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-law search for one question among the cases since 1995."""
    return R.case_search(judgments(spark, sf_dir), paragraphs(spark, sf_dir), query_vector(spark, sf_dir), WORDS, R.RERANKED, year_from=1995)


@query("RET-01 FLT-01 FLT-02 FLT-03 JOIN-04 ARR-01", hybrid_sql("court ILIKE '%src1%' AND year <= 2020 AND list_contains(judges, 'en') AND id IN (SELECT doc_id FROM labels WHERE toxic = 0)", 10))
def hybrid_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search under every filter: court, year, judge and a linked section."""
    links = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.col("toxic").alias("act_section_id"))
    return R.case_search(judgments(spark, sf_dir), paragraphs(spark, sf_dir), query_vector(spark, sf_dir), WORDS, 10, court="src1", year_to=2020, judge="en", links=links, act_section=0)


@query("FLT-01 ARR-01", f"WITH {CASES} SELECT id, court, year, citation FROM cases WHERE court ILIKE '%SRC1%' AND year BETWEEN 2000 AND 2010 AND list_contains(judges, 'fr')")
def filter_ilike_year_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_cases(judgments(spark, sf_dir), court="SRC1", year_from=2000, year_to=2010, judge="fr").select("id", "court", "year", "citation")


CHUNKS = """chunks AS (SELECT vec_id AS id, doc_id, source AS file_id, lang AS source_type, 'c' || (doc_id % 4) AS collection_id,
  ['concept', 'example', 'question'][label % 3 + 1] AS chunk_type, embedding::DOUBLE[] AS embedding, text FROM documents JOIN embeddings ON doc_id = vec_id)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded documents as chunks of collections and files."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    kind = F.element_at(F.array(F.lit("concept"), F.lit("example"), F.lit("question")), F.col("label") % 3 + 1)
    joined = docs.join(vectors, F.col("doc_id") == F.col("vec_id"))
    return joined.select(
        F.col("vec_id").alias("id"), "doc_id", F.col("source").alias("file_id"), F.col("lang").alias("source_type"),
        F.concat(F.lit("c"), (F.col("doc_id") % 4).cast("string")).alias("collection_id"), kind.alias("chunk_type"), "embedding", "text",
    )


SIM = "round(list_cosine_similarity(embedding, v), 9) AS score"


@query("SORT-06 MATH-02", f"WITH {CHUNKS}, {QVEC} SELECT id, chunk_type, {SIM} FROM chunks, q ORDER BY score DESC, id LIMIT 25")
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_top_k(chunks(spark, sf_dir), query_vector(spark, sf_dir), 25).select("id", "chunk_type", "score")


@query("FLT-04 SORT-06", f"WITH {CHUNKS}, {QVEC} SELECT id, file_id, collection_id, {SIM} FROM chunks, q WHERE collection_id IN ('c1', 'c2') AND source_type = 'en' AND chunk_type = 'concept' ORDER BY score DESC, id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.vector_top_k(chunks(spark, sf_dir), query_vector(spark, sf_dir), 10, collection_id=["c1", "c2"], source_type="en", chunk_type="concept")
    return found.select("id", "file_id", "collection_id", "score")


@query("FLT-05 FLT-08", f"WITH {CHUNKS}, {QVEC}, top AS (SELECT id, chunk_type, {SIM} FROM chunks, q ORDER BY score DESC, id LIMIT 30) SELECT * FROM top WHERE chunk_type = 'example'")
def content_type_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition applies to the top chunks; it must not reach below the limit."""
    return R.vector_top_k(chunks(spark, sf_dir), query_vector(spark, sf_dir), 30).where("chunk_type = 'example'").select("id", "chunk_type", "score")


@query("SORT-07 STR-02", f"""WITH {CHUNKS}, {QVEC}, top AS (SELECT id, chunk_type, {SIM} FROM chunks, q ORDER BY score DESC, id LIMIT 30),
pos AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM top) SELECT id, chunk_type, pos FROM pos ORDER BY (chunk_type <> 'question')::INT, pos LIMIT 12""")
def intent_partition_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.vector_top_k(chunks(spark, sf_dir), query_vector(spark, sf_dir), 30)
    numbered = R.ranked(top, [F.desc("score"), F.asc("id")], 30, "pos")
    return R.intent_first(numbered, "question", 12).select("id", "chunk_type", "pos")


@query("SORT-08 SORT-09 UDF-02", f"""WITH {CHUNKS}, {QVEC}, top AS (SELECT id, length(text) AS n, {SIM} FROM chunks, q ORDER BY score DESC, id LIMIT 50),
pos AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM top)
SELECT id, pos, round(CASE WHEN id % 4 = 0 THEN 1 - 0.01::DOUBLE * (pos - 1) ELSE n::DOUBLE / (n + 1000) END, 9) AS rerank_score FROM pos ORDER BY rerank_score DESC, pos LIMIT 20""")
def citation_boost_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranking by a stand-in scorer (length), which leaves some chunks unscored."""
    top = R.vector_top_k(chunks(spark, sf_dir), query_vector(spark, sf_dir), 50)
    n = F.length("text")
    scored = R.ranked(top, [F.desc("score"), F.asc("id")], 50, "pos").withColumn("rerank_score", F.when(F.col("id") % 4 != 0, n / (n + 1000.0)))
    return R.reranked(scored, 20).select("id", "pos", "rerank_score")


@query("FLT-06 AGG-06", f"WITH {CHUNKS}, {QVEC}, top AS (SELECT id, {SIM} FROM chunks, q ORDER BY score DESC, id LIMIT 40) SELECT coalesce(max(score), 0::DOUBLE) AS confidence, count(*) AS n FROM top WHERE score >= 0.4")
def threshold_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.vector_top_k(chunks(spark, sf_dir), query_vector(spark, sf_dir), 40)
    return R.confidence(top.where(F.col("score") >= R.RELEVANCE))


@query("AGG-14 SORT-11", "WITH t AS (SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text) SELECT doc_id, copies, length(text)::BIGINT AS n FROM t")
def exact_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text; texts meet by their digest, so they are never shuffled themselves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))
    return docs.groupBy("digest", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies", F.col("n").cast("long").alias("n"))


@query("SET-01 RET-04", f"""WITH {CHUNKS}, {QVEC}, s AS (SELECT id, file_id, {SIM} FROM chunks, q),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, id) AS rn FROM s) SELECT id, file_id, score, rn FROM r WHERE rn <= 8""")
def per_file_topk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's eight most similar chunks."""
    rows = chunks(spark, sf_dir)
    scored = rows.withColumn("score", F.round(R.cosine_similarity(F.col("embedding"), R.literal(query_vector(spark, sf_dir))), 9)).select("id", "file_id", "score")
    return R.best_of_each(scored, "file_id", [F.desc("score"), F.asc("id")], 8)


FB = """fb AS (SELECT vec_id AS feedback_id, embedding::DOUBLE[] AS q_vec, [vec_id, vec_id + 1] AS doc_ids, quality AS label, 'c' || (vec_id % 2) AS collection
  FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id WHERE e.label < 3)"""


@query("JOIN-05 SRC-10", f"WITH {FB}, {QVEC}, s AS (SELECT feedback_id, label, round(list_cosine_similarity(q_vec, v), 9) AS similarity FROM fb, q WHERE collection = 'c0') SELECT * FROM s WHERE similarity >= 0.1")
def feedback_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback on similar questions (the made-up vectors are far apart, so at 0.1)."""
    return R.relevant_feedback(feedback(spark, sf_dir), query_vector(spark, sf_dir), "c0", 0.1).select("feedback_id", "label", "similarity")


SCORES = "scores AS (SELECT doc_id, count_if(label = 1) AS positive, count(*) AS n, round((count_if(label = 1) + 1)::DOUBLE / (count(*) + 2), 9) AS feedback_score FROM (SELECT unnest(doc_ids) AS doc_id, label FROM fb) GROUP BY doc_id)"


@query("JOIN-06 AGG-07", f"WITH {FB}, {SCORES} SELECT doc_id, positive::BIGINT AS positive, n, feedback_score FROM scores")
def feedback_bayes_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.feedback_scores(feedback(spark, sf_dir))


@query("JOIN-07 MATH-05", f"""WITH {CHUNKS}, {QVEC}, {FB}, {SCORES}, top AS (SELECT doc_id, {SIM} FROM chunks, q ORDER BY score DESC, id LIMIT 50)
SELECT t.doc_id, t.score, coalesce(feedback_score, 0.5::DOUBLE) AS feedback_score,
  round(0.45::DOUBLE * score + 0.35::DOUBLE * (score / 2) + 0.1::DOUBLE * coalesce(feedback_score, 0.5::DOUBLE) + 0.1::DOUBLE * coalesce(feedback_score, 0.5::DOUBLE), 9) AS final_score
FROM top t LEFT JOIN scores s ON t.doc_id = s.doc_id""")
def feedback_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.vector_top_k(chunks(spark, sf_dir), query_vector(spark, sf_dir), 50).select("doc_id", "score", (F.col("score") / 2).alias("rerank_score"))
    return R.with_feedback(top, R.feedback_scores(feedback(spark, sf_dir))).select("doc_id", "score", "feedback_score", "final_score")


@query("AGG-08", f"""WITH {FB} SELECT count(*) AS total, count_if(label = 1)::BIGINT AS positive, count_if(label = 0)::BIGINT AS negative,
round(CASE WHEN count(*) = 0 THEN 0 ELSE count_if(label = 1)::DOUBLE / count(*) END, 9) AS ratio, string_agg(DISTINCT collection, ',' ORDER BY collection) AS collections FROM fb""")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    positive = F.count_if(F.col("label") == 1)
    return feedback(spark, sf_dir).agg(
        F.count("*").alias("total"), positive.alias("positive"), F.count_if(F.col("label") == 0).alias("negative"),
        F.round(F.when(F.count("*") == 0, 0.0).otherwise(positive / F.count("*")), 9).alias("ratio"), F.array_join(F.sort_array(F.collect_set("collection")), ",").alias("collections"),
    )


@query("SORT-05", f"WITH {PARAS}, {QVEC} SELECT id, judgment_id, round(1 - list_cosine_similarity(embedding, v), 9) AS distance FROM paras, q WHERE judgment_id % 10 = 3 ORDER BY distance, id LIMIT 10")
def case_paragraphs_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest paragraphs of some cases."""
    own = paragraphs(spark, sf_dir).where("judgment_id % 10 = 3")
    near = own.select("id", "judgment_id", F.round(R.cosine_distance(F.col("embedding"), R.literal(query_vector(spark, sf_dir))), 9).alias("distance"))
    return near.orderBy("distance", "id").limit(10)
