"""Reference files that drafts and translations rest on: templates, examples, glossaries, read as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Types of documents that share the examples of another.
EXAMPLE_KEYS = {
    "legal_notice": "legal_notice", "demand_notice": "legal_notice", "affidavit": "affidavit", "petition": "petition", "application": "application",
    "contract": "contract", "agreement": "contract", "bail_application": "bail_application", "criminal_appeal": "criminal_appeal",
}


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """``category``, ``sub_type``, ``body`` of the files under ``folder``, which names both: category=.../sub_type=.../file."""
    return spark.read.option("basePath", folder).schema("value string, category string, sub_type string").text(folder, wholetext=True).select("category", "sub_type", F.col("value").alias("body"))


def with_template(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests (category, sub_type) with their template; null where there is none."""
    return requests.join(known, ["category", "sub_type"], "left")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """``term``, ``translation`` of a file of ``term: translation`` lines; what has no translation, or is a comment, is left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    part = lambda i: F.regexp_extract("value", r"^\s*[\"']?(.*?)[\"']?\s*:\s+[\"']?(.*?)[\"']?\s*$", i)
    return lines.select(part(1).alias("term"), part(2).alias("translation")).where("term <> '' AND translation <> ''")


def examples(spark: SparkSession, path: str) -> DataFrame:
    """``kind``, ``subtype``, ``language``, ``structure``, ``example`` of JSON lines; an absent subtype or language is the base."""
    return spark.read.schema("kind string, subtype string, language string, structure string, example string").json(path)


def example_key(kind: Column) -> Column:
    """Under which kind a document's examples stand."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in EXAMPLE_KEYS.items() for x in pair])[kind], kind)


def with_examples(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests (id, kind, subtype, language) with the structure and example of their subtype, else of the base kind.

    A variant in the request's language goes before both, field by field, and what it lacks comes from them.
    """
    asked = requests.withColumn("key", example_key(F.col("kind")))
    held = known.select(F.col("kind").alias("key"), F.col("subtype").alias("__subtype"), F.col("language").alias("__language"), "structure", "example")
    right_type = F.col("__subtype").isNull() | (F.col("__subtype") == F.col("subtype"))
    right_language = F.col("__language").isNull() | ((F.col("__language") == F.col("language")) & (F.col("language") != "english"))
    met = asked.join(held, "key", "left").withColumn("fits", right_type & right_language)
    weight = F.when(F.col("fits"), F.when(F.col("__language").isNotNull(), 2).otherwise(0) + F.when(F.col("__subtype").isNotNull(), 1).otherwise(0))
    best = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), weight)).alias(c)
    return met.groupBy(*requests.columns).agg(best("structure"), best("example"))
