"""Hybrid retrieval: filters, vector and lexical ranks, reciprocal-rank fusion, boosts, feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketeer.functions.vectors import cosine_distance, cosine_similarity, literal
from docketeer.operators import lexical_index
from docketeer.operators.vector_layout import VectorLayout

# Fusion and boost constants, candidate sizes, thresholds and weights of the scores.
SEMANTIC_WEIGHT, LEXICAL_WEIGHT, RRF_K, ABSENT_RANK = 0.7, 0.3, 60, 1000
CITATION_BOOST = 0.05
CANDIDATES, FUSED, RERANKED = 100, 50, 20
RELEVANCE, FEEDBACK_SIMILARITY, NO_FEEDBACK = 0.4, 0.8, 0.5
ORIGINAL_WEIGHT, RERANK_WEIGHT, FEEDBACK_WEIGHT = 0.45, 0.35, 0.10


def filter_cases(cases: DataFrame, court: str | None = None, year_from: int | None = None, year_to: int | None = None, judge: str | None = None, links: DataFrame | None = None, act_section: object = None) -> DataFrame:
    """All given conditions hold; empty and zero values are no condition. ``links``: case_id, act_section_id."""
    conditions: list[Column] = []
    if court:
        conditions.append(F.col("court").ilike(f"%{court}%"))
    if year_from:
        conditions.append(F.col("year") >= year_from)
    if year_to:
        conditions.append(F.col("year") <= year_to)
    if judge:
        conditions.append(F.array_contains("judges", judge))
    kept = cases.where(reduce(Column.__and__, conditions)) if conditions else cases
    if links is not None and act_section is not None and act_section != "":
        kept = kept.join(links.where(F.col("act_section_id") == act_section), kept.id == links.case_id, "left_semi")
    return kept


def filter_chunks(chunks: DataFrame, **wanted: object) -> DataFrame:
    """Payload conditions: a value means equality, a list membership; none given, no filter."""
    for column, value in wanted.items():
        if isinstance(value, (list, tuple)):
            chunks = chunks.where(F.col(column).isin(list(value))) if value else chunks
        elif value is not None:
            chunks = chunks.where(F.col(column) == value)
    return chunks


def ranked(rows: DataFrame, order: list[Column], limit: int, rank: str) -> DataFrame:
    """The first rows in an order, numbered. Only ``limit`` rows reach the numbering."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def kept_with(paragraphs: DataFrame) -> list[str]:
    """What a ranking keeps of its paragraphs: the id, and the judgment's, so that it needn't be looked up again."""
    return [c for c in ("id", "judgment_id") if c in paragraphs.columns]


def semantic_ranks(paragraphs: DataFrame, vector: list[float], limit: int = CANDIDATES) -> DataFrame:
    """id, distance (to nine places) and rank_s of the nearest paragraphs; equal distances go by id."""
    near = paragraphs.select(*kept_with(paragraphs), F.round(cosine_distance(F.col("embedding"), literal(vector)), 9).alias("distance"))
    return ranked(near, [F.asc("distance"), F.asc("id")], limit, "rank_s")


def lexical_score(text: Column, words: list[str]) -> Column:
    """Sum of tf / (1 + tf) over the words, null unless all of them occur.

    It stands in for a text-search rank with stemming, which neither Spark nor SQL has.
    """
    # the tokens, and then their counts, are bound to a lambda's variable, so each is computed once
    tokens = F.array(F.split(F.lower(text), "[^a-z0-9]+"))
    count = lambda own, word: F.size(F.filter(own, lambda t: t == word))
    counts = F.transform(tokens, lambda own: F.array(*[count(own, w) for w in words]))
    parts = lambda n: [n[i] / (1.0 + n[i]) for i in range(len(words))]
    return F.transform(counts, lambda n: F.when(F.array_min(n) > 0, reduce(Column.__add__, parts(n))))[0]


def lexical_ranks(paragraphs: DataFrame, words: list[str], limit: int = CANDIDATES) -> DataFrame:
    """id, lexical score and rank_f of the best matches."""
    # the cheap test comes first, so texts without a word are never divided into tokens
    possible = paragraphs.where(reduce(Column.__and__, [F.lower("body").contains(w) for w in words]))
    scored = possible.select(*kept_with(paragraphs), F.round(lexical_score(F.col("body"), words), 9).alias("lexical")).where("lexical IS NOT NULL")
    return ranked(scored, [F.desc("lexical"), F.asc("id")], limit, "rank_f")


def fuse(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """Weighted reciprocal-rank fusion of two rankings by id; a missing rank counts as ``ABSENT_RANK``."""
    keys = [c for c in ("id", "judgment_id") if c in semantic.columns and c in lexical.columns]
    both = semantic.select(*keys, "rank_s").join(lexical.select(*keys, "rank_f"), keys, "full_outer")
    part = lambda weight, rank: F.lit(weight) / (RRF_K + F.coalesce(F.col(rank), F.lit(ABSENT_RANK)))
    return both.withColumn("rrf_score", part(SEMANTIC_WEIGHT, "rank_s") + part(LEXICAL_WEIGHT, "rank_f"))


def boosted(score: Column, citation: Column) -> Column:
    """Cited cases gain a constant."""
    return F.when(citation.isNotNull() & (citation != ""), score + CITATION_BOOST).otherwise(score)


def case_search(cases: DataFrame, paragraphs: DataFrame, vector: list[float], words: list[str], top_k: int = 5, **filters: object) -> DataFrame:
    """Hybrid case-law search: filter, rank twice, fuse, take the best fifty, boost, and return ``top_k``."""
    kept = filter_cases(cases, **filters)
    within = paragraphs.join(kept.select(F.col("id").alias("judgment_id")), "judgment_id", "left_semi")
    return best_cases(fuse(semantic_ranks(within, vector), lexical_ranks(within, words)), kept, top_k)


def best_cases(fused: DataFrame, kept: DataFrame, top_k: int) -> DataFrame:
    """The best fifty of a fused ranking with their cases, those with a citation boosted, and of these the best ``top_k``."""
    fused = fused.orderBy(F.desc("rrf_score"), F.asc("id")).limit(FUSED)
    found = fused.join(kept.withColumnRenamed("id", "judgment_id"), "judgment_id")
    scored = found.withColumn("score", F.round(boosted(F.col("rrf_score"), F.col("citation")), 9))
    return scored.select("id", "judgment_id", "court", "year", "citation", "rank_s", "rank_f", "score").orderBy(F.desc("score"), F.asc("id")).limit(top_k)


def indexed_case_search(cases: DataFrame, layout: VectorLayout, index: DataFrame, vector: list[float], question: str, top_k: int = 5, **filters: object) -> DataFrame:
    """``case_search`` over vectors by cell and postings of stems: it reads the cells and the terms that matter, and ranks texts as their words come close."""
    kept = filter_cases(cases, **filters)
    own = kept.select(F.col("id").alias("judgment_id"))
    among = lambda rows: rows.join(own, "judgment_id", "left_semi")
    near = layout.search(vector, CANDIDATES, among).select("id", "judgment_id", "distance")
    matches = among(lexical_index.matching(index, question))
    semantic = ranked(near, [F.asc("distance"), F.asc("id")], CANDIDATES, "rank_s")
    lexical = ranked(matches, [F.desc("lexical"), F.asc("id")], CANDIDATES, "rank_f")
    return best_cases(fuse(semantic, lexical), kept, top_k)


def vector_top_k(chunks: DataFrame, vector: list[float], k: int, **wanted: object) -> DataFrame:
    """The filtered chunks most similar to the vector, with their score."""
    scored = filter_chunks(chunks, **wanted).withColumn("score", F.round(cosine_similarity(F.col("embedding"), literal(vector)), 9))
    return scored.orderBy(F.desc("score"), F.asc("id")).limit(k)


def intent_first(rows: DataFrame, intent: str | None, limit: int) -> DataFrame:
    """Chunks of the intended type first, otherwise in their order (``pos``)."""
    first = [F.when(F.col("chunk_type") == intent, 0).otherwise(1)] if intent else []
    return rows.orderBy(*first, "pos").limit(limit)


def reranked(rows: DataFrame, top_k: int) -> DataFrame:
    """By ``rerank_score``, ties by position; a missing one is 1 - 0.01 for each place before it (``pos`` from 1)."""
    score = F.coalesce(F.col("rerank_score"), 1 - 0.01 * (F.col("pos") - 1))
    return rows.withColumn("rerank_score", F.round(score, 9)).orderBy(F.desc("rerank_score"), "pos").limit(top_k)


def relevant_feedback(feedback: DataFrame, vector: list[float], collection: str, threshold: float = FEEDBACK_SIMILARITY) -> DataFrame:
    """Feedback of the collection whose query was similar."""
    similar = F.round(cosine_similarity(F.col("q_vec"), literal(vector)), 9)
    return feedback.where(F.col("collection") == collection).withColumn("similarity", similar).where(F.col("similarity") >= threshold)


def feedback_scores(feedback: DataFrame) -> DataFrame:
    """doc_id and its smoothed share of positive feedback, (positive + 1) / (all + 2)."""
    shown = feedback.select(F.explode("doc_ids").alias("doc_id"), "label")
    counted = shown.groupBy("doc_id").agg(F.count_if(F.col("label") == 1).alias("positive"), F.count("*").alias("n"))
    return counted.select("doc_id", "positive", "n", F.round((F.col("positive") + 1) / (F.col("n") + 2), 9).alias("feedback_score"))


def with_feedback(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Results (doc_id, score, rerank_score) with the blended score; documents without feedback have 0.5."""
    joined = results.join(scores.select("doc_id", "feedback_score"), "doc_id", "left")
    fb = F.coalesce("feedback_score", F.lit(NO_FEEDBACK))
    blend = ORIGINAL_WEIGHT * F.col("score") + RERANK_WEIGHT * F.col("rerank_score") + FEEDBACK_WEIGHT * fb + FEEDBACK_WEIGHT * fb
    return joined.withColumns({"feedback_score": fb, "final_score": F.round(blend, 9)})


def confidence(results: DataFrame) -> DataFrame:
    """The best score, 0 where there is none."""
    return results.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("confidence"), F.count("*").alias("n"))


def best_of_each(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, numbered ``rn``."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= k)


def round_robin(rows: DataFrame, label: str, position: str, limit: int) -> DataFrame:
    """One row of each label in turn, labels in the order of their first row."""
    own = Window.partitionBy(label)
    turns = rows.withColumns({"turn": F.row_number().over(own.orderBy(position)).cast("long"), "first_at": F.min(position).over(own)})
    return turns.orderBy("turn", "first_at").limit(limit)
