"""A training corpus from raw documents: language, recurring lines, near copies, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.llm import decontam, language, linededup, packing, simhash
from docketeer.llm.common import discard, documents, save, table
from docketeer.llm.queries import tokenizer_path


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns of these names renamed, and how to name them back: an operator adds its own."""
    back = {f"__own_{c}": c for c in docs.columns if c in names}
    return docs.withColumnsRenamed({c: own for own, c in back.items()}), back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with it in ``lang``: those without a letter, null texts included, go.

    The languages are learned from the labels that the documents come with; if there are none, ``lang`` stays as it is.
    """
    model = language.learn(docs)
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows, back = set_aside(docs, "lang_pred", "score", "phrases")
    known = language.identify(rows, model).where(F.col("lang_pred") != language.UNDETERMINED)
    return known.withColumn("lang", F.col("lang_pred")).drop("lang_pred", "score", "phrases").withColumnsRenamed(back).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template an earlier one has; ``n_chars`` follows the text. None goes."""
    rows, back = set_aside(docs, "n_lines", "n_dropped")
    left = linededup.drop_recurring(rows, by_leaf=True).drop("n_lines", "n_dropped").withColumnsRenamed(back).select(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Of each group the row with the least id stays; rows without an id come last. Null and empty texts are one group. Of repeated rows one stays.
    """
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows, and rows without an id, are judged each by its text."""
    return decontam.without_matches(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences of 4096. A null text counts as empty; repeated rows, and rows without an id, are packed each."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Cross-parsing, SimHash and tokenizers have no SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder, read again by the next, and then deleted."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
