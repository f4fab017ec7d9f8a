"""Tables in buckets: joins on the key need no shuffle, a lookup reads one bucket."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docketeer.sources.shared import delete, shared_folder


class Bucketed:
    """Tables written by bucket of a key and sorted by it, known to this session by names of their own; used as a context they go at its end.

    All have the same number of buckets, so any two of them that are joined on their keys meet bucket by bucket.
    """

    def __init__(self, spark: SparkSession, buckets: int = 16) -> None:
        self.spark, self.buckets = spark, buckets
        self.folder = f"{shared_folder(spark)}/bucketed-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def write(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows dealt to their buckets by one shuffle, so that each bucket is one file, in the order of the key."""
        name = f"bucketed_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, key)
        dealt.write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *_: object) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.folder)
