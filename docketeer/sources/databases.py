"""Tables of a relational database, read and written through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def database_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 16, fetch: int = 10_000, **options: str) -> DataFrame:
    """A table, its filters and columns left to the database. With a numeric ``key`` it is read in ``parts`` ranges of it."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize=fetch, **options)
    if key:
        least = spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {name}", **options).load().first()
        if least[0] is not None:
            reader = reader.options(partitionColumn=key, lowerBound=least[0], upperBound=least[1] + 1, numPartitions=parts)
    return reader.load()


def append_table(rows: DataFrame, url: str, name: str, batch: int = 500, **options: str) -> None:
    """Appends rows in batches; each task has a connection of its own."""
    rows.write.format("jdbc").options(url=url, dbtable=name, batchsize=batch, **options).mode("append").save()
