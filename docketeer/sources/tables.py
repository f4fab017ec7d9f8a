"""The driver's tables, and the legal entities derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows that come in fewer parts than the session has cores, dealt to all of them; larger tables stay as they are.

    For work that is heavy on each row: a small table is often one row group, which one task reads however many cores are free.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as judgments: id, title, court, year, judges, citation (every third has one), body."""
    year = (F.col("doc_id") % 35 + 1990).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.left("text", F.lit(40)).alias("title"),
        F.col("source").alias("court"),
        year.alias("year"),
        F.array("lang", "source").alias("judges"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("("), year.cast("string"), F.lit(") 5 SCC "), F.col("doc_id").cast("string"))).alias("citation"),
        F.col("text").alias("body"),
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an embedding as paragraphs: id, judgment_id, paragraph_number, body, embedding."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    joined = docs.join(vectors, F.col("doc_id") == F.col("vec_id"))
    return joined.select(F.col("vec_id").alias("id"), F.col("doc_id").alias("judgment_id"), (F.col("doc_id") % 7).alias("paragraph_number"), F.col("text").alias("body"), "embedding", "label")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback rows: a query vector, the documents shown, whether they helped, and the collection."""
    vectors, labels = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels")
    shown = F.array("vec_id", F.col("vec_id") + 1)
    rows = vectors.where("label < 3").join(labels, F.col("vec_id") == F.col("doc_id"))
    return rows.select(F.col("vec_id").alias("feedback_id"), F.col("embedding").alias("q_vec"), shown.alias("doc_ids"), F.col("quality").alias("label"), F.concat(F.lit("c"), (F.col("vec_id") % 2).cast("string")).alias("collection"))
