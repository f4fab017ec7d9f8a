"""Composite flows over a workspace: ingestion, answers with feedback, precedents, verification."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketeer.functions import legal
from docketeer.operators import chunking, ingest, retrieval
from docketeer.operators.substring_join import contained

# How many internal precedents suffice, and results that are shown.
ENOUGH_INTERNAL, SHOWN_CHUNKS = 5, 10


def ingestion(files: DataFrame) -> DataFrame:
    """Files (file_id, path, text) with a status, and their chunk counts: parsed by type, cut into paragraphs.

    A file that no parser takes, or that has no text, fails with a reason; the others don't wait for it.
    """
    kind = ingest.source_type(F.col("path"))
    known = files.withColumn("kind", kind)
    texts = known.where("kind IS NOT NULL").select(F.col("file_id").alias("doc_id"), "text")
    counts = chunking.exploded(texts, chunking.paragraphs).groupBy(F.col("doc_id").alias("file_id")).agg(F.count("*").alias("n_chunks"))
    joined = known.join(counts, "file_id", "left")
    n = F.coalesce("n_chunks", F.lit(0)).cast("long")
    reason = F.when(F.col("kind").isNull(), "unsupported type").when(n == 0, "no text")
    return joined.select("file_id", "kind", n.alias("n_chunks"), F.when(reason.isNull(), "completed").otherwise("failed").alias("status"), reason.alias("reason"))


def hash_embedding(text: Column, width: int = 64) -> Column:
    """A stand-in for an embedding model: signed counts of hashed words. Equal texts have equal vectors."""
    hashes = F.transform(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.xxhash64(w))

    @F.arrow_udf("array<double>")
    def counted(lists: pa.Array) -> pa.Array:
        """Each row's hashes are added up in the row's own slots, those of all rows in one pass."""
        values, n = lists.flatten().to_numpy(), len(lists)
        rows = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        sums = np.bincount(rows * width + values % width, np.where(values > 0, 1.0, -1.0), minlength=n * width)
        return pa.FixedSizeListArray.from_arrays(sums, width, mask=lists.is_null()).cast(pa.list_(pa.float64()))

    return counted(hashes)


def answer_context(chunks: DataFrame, vector: list[float], feedback: DataFrame, collection: str, limit: int = 20, intent: str | None = None, content_type: str | None = None, **filters: object) -> DataFrame:
    """The chunks that an answer is built on: similar, of the right type, reranked, blended with feedback, relevant.

    Reranking has a stand-in score, the share of the text's first thousand characters that it fills.
    """
    top = retrieval.vector_top_k(chunks, vector, limit, **filters)
    if content_type:
        top = top.where(F.col("chunk_type") == content_type)
    numbered = retrieval.ranked(top, [F.desc("score"), F.asc("id")], limit, "pos")
    ordered = retrieval.intent_first(numbered, intent, limit)
    scored = ordered.withColumn("rerank_score", F.least(F.length("text") / 1000.0, F.lit(1.0)))
    similar = retrieval.relevant_feedback(feedback, vector, collection)
    blended = retrieval.with_feedback(scored, retrieval.feedback_scores(similar))
    kept = blended.where(F.col("final_score") >= retrieval.RELEVANCE)
    return kept.select("id", "doc_id", "chunk_type", "score", "rerank_score", "feedback_score", "final_score").orderBy(F.desc("final_score"), "id").limit(SHOWN_CHUNKS)


def precedents(internal: DataFrame, web: DataFrame, top_k: int) -> DataFrame:
    """Internal precedents, and web ones behind them where there are under five; each with its place."""
    more = web.where(internal.agg(F.count("*")).scalar() < ENOUGH_INTERNAL)
    rows = internal.withColumn("source_no", F.lit(0)).unionByName(more.withColumn("source_no", F.lit(1)))
    return retrieval.ranked(rows, [F.asc("source_no"), F.desc("score"), F.asc("id")], top_k, "place")


def verified(claims: DataFrame, evidence: DataFrame, most: int = 7) -> DataFrame:
    """The first claims (id, text, kind) with the first evidence (id, url, body) that holds one of their anchors.

    The few claims' anchors go to every row of evidence as one constant; the evidence is read once and not shuffled.
    """
    first = claims.orderBy("id").limit(most).select("id", anchors(F.col("text"), F.col("kind")).alias("anchors"))
    packed = first.agg(F.collect_list(F.struct("id", "anchors"))).scalar()
    rows = evidence.select("id", "url", F.lower("body").alias("hay"), packed.alias("claims"))
    supports = lambda c: F.exists(c["anchors"], lambda a: F.contains(F.col("hay"), F.lower(a)))
    hits = rows.select(F.struct("id", "url").alias("hit"), F.explode(F.filter("claims", supports)).alias("c"))
    best = hits.groupBy(F.col("c.id").alias("id")).agg(F.min("hit").alias("hit"))
    return first.join(best, "id", "left").select("id", F.col("hit").isNotNull().alias("supported"), F.col("hit.url").alias("url"))


def anchors(text: Column, kind: Column) -> Column:
    """What a snippet must hold of a claim: its numbers, its capitalised phrases, or the quoted words; three characters at least."""
    numbers = F.regexp_extract_all(text, F.lit(r"\b\d+(?:[.,]\d+)*\s*%?"), F.lit(0))
    phrases = F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Za-z&]+(?:\s+[A-Z][A-Za-z&]+)+"), F.lit(0))
    quoted = F.regexp_extract(text, "[\"“]([^\"”]{10,})[\"”]", 1)
    quote = F.array(F.when(quoted != "", quoted).otherwise(F.left(text, F.lit(60))))
    found = F.when(kind.isin("date", "number"), numbers).when(kind.isin("case_citation", "statute", "entity"), phrases).when(kind == "quote", quote).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.transform(found, lambda s: F.trim(s))), lambda s: F.length(s) >= 3)


def candidate_terms(pages: DataFrame, most: int = 400) -> DataFrame:
    """Title-case or capital phrases of one to four words, the first spelling of each, in order of appearance.

    ``pages``: page, text.
    """
    pattern = r"\b(?:[A-Z][a-z]+|[A-Z]{2,})(?:\s+(?:[A-Z][a-z]+|[A-Z]{2,})){0,3}\b"
    found = pages.select("page", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "term")).where(F.length("term") >= 3)
    first = found.groupBy(F.lower("term").alias("key")).agg(F.min(F.struct("page", "pos", "term")).alias("f"))
    return first.select("f.*").orderBy("page", "pos").limit(most)


def grounding(drafts: DataFrame) -> DataFrame:
    """Citations of each draft (id, draft, corpus), and those that the tools' results don't hold."""
    cited = legal.citations(F.col("draft"))
    rows = drafts.withColumn("cited", cited)
    missing = legal.grounded(F.col("cited"), F.col("corpus"))
    return rows.select("id", F.size("cited").cast("long").alias("n"), F.array_join(missing, "|").alias("unverified"))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Rows of an ordered group in batches of a fixed size. ``rows`` has the group in ``group``."""
    number = F.row_number().over(Window.partitionBy("group").orderBy(order))
    return rows.withColumn("batch", F.floor((number - 1) / size))


def translated_batch(texts: Column, translate: Callable[[Column], Column], separator: str) -> Column:
    """``parts`` and ``way``: the texts translated as one, divided at the separator; where that gives another number of parts, one by one."""
    parts = F.split(translate(F.array_join(texts, separator)), re.escape(separator), -1)
    held = lambda x: F.when(F.size(x["p"]) == F.size(x["t"]), F.struct(x["p"].alias("parts"), F.lit("batch").alias("way"))).otherwise(F.struct(F.transform(x["t"], translate).alias("parts"), F.lit("items").alias("way")))
    return F.transform(F.array(F.struct(parts.alias("p"), texts.alias("t"))), held)[0]


def checked(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Drafts (id, draft) with the report of their citations, each with the first evidence (id, url, body) that holds it, and rewritten without the others.

    ``supported`` and ``unsupported`` list the citations; in ``rewritten`` those without evidence are marked. Citations meet the evidence by rare
    parts of them, whatever their case, not each with all. A draft without citations stays as it is.
    """
    claims = drafts.select("id", F.posexplode(F.array_distinct(legal.citations(F.col("draft")))).alias("pos", "claim"))
    bodies = evidence.select("id", F.lower("body").alias("text"))
    found = contained(bodies, claims.select(F.lower("claim").alias("term"))).groupBy("term").agg(F.min("id").alias("evidence"))
    first = found.join(evidence.select(F.col("id").alias("evidence"), "url"), "evidence").select("term", "url")
    told = claims.join(first, F.lower("claim") == F.col("term"), "left")
    of_draft = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "claim", "url"))).alias("claims"))
    rows = drafts.join(of_draft, "id", "left").withColumn("claims", F.coalesce("claims", F.array().cast("array<struct<pos:int,claim:string,url:string>>")))
    without = F.filter("claims", lambda c: c["url"].isNull())
    held = F.filter("claims", lambda c: c["url"].isNotNull())
    return rows.select(
        "id", F.size("claims").alias("n"),
        F.array_join(F.transform(held, lambda c: F.concat(c["claim"], F.lit(" <- "), c["url"])), "|").alias("supported"),
        F.array_join(F.transform(without, lambda c: c["claim"]), "|").alias("unsupported"),
        F.aggregate(without, F.col("draft"), lambda t, c: F.replace(t, c["claim"], F.lit("[unverified]"))).alias("rewritten"),
    )
