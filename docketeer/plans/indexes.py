"""Searches through what is written beforehand: vectors by cell, postings of stems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketeer.operators import lexical_index as L
from docketeer.operators import retrieval as R
from docketeer.operators.vector_layout import VectorLayout, write_cells
from docketeer.plans.registry import query
from docketeer.plans.retrieval import PARAS, QVEC, query_vector
from docketeer.sources.shared import few, scratch
from docketeer.sources.tables import judgments, paragraphs

QUESTION = "the attions of then and thed"


@query("SRC-03 SORT-01 SORT-06 MATH-01", f"WITH {PARAS}, {QVEC} SELECT id, judgment_id, round(1 - list_cosine_similarity(embedding, v), 9) AS distance FROM paras, q ORDER BY distance, id LIMIT 50")
def vector_search_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty nearest paragraphs, from vectors written by cell."""
    with scratch(spark) as path:
        write_cells(paragraphs(spark, sf_dir).select("id", "judgment_id", "embedding"), path, cells=32)
        return few(VectorLayout(spark, path).search(query_vector(spark, sf_dir), 50).select("id", "judgment_id", "distance"))


@query("MATH-06 WIN-02 SORT-02")
def stemmed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred paragraphs that a question's stems rank highest, from postings."""
    with scratch(spark) as path:
        L.write_postings(paragraphs(spark, sf_dir).select("id", "judgment_id", "body"), path)
        found = L.matching(L.read_postings(spark, path), QUESTION)
        return few(R.ranked(found, [R.F.desc("lexical"), R.F.asc("id")], R.CANDIDATES, "rank_f"))


@query("RET-01 MATH-03 MATH-06 SRC-03 WIN-01 WIN-02")
def hybrid_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-law search for one question among the cases since 1995, over both."""
    with scratch(spark) as path:
        own = paragraphs(spark, sf_dir)
        write_cells(own.select("id", "judgment_id", "embedding"), f"{path}/vectors", cells=32)
        L.write_postings(own.select("id", "judgment_id", "body"), f"{path}/postings")
        layout, index = VectorLayout(spark, f"{path}/vectors"), L.read_postings(spark, f"{path}/postings")
        return few(R.indexed_case_search(judgments(spark, sf_dir), layout, index, query_vector(spark, sf_dir), QUESTION, R.RERANKED, year_from=1995))
