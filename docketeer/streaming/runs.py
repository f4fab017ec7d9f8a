"""Streams over growing tables: job states, feedback, event windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docketeer.sources.shared import delete, shared_folder


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 4) -> DataFrame:
    """A table as a stream of its files, those added later included."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # the source takes folders and patterns, and a small table may be one file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def to_the_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all there is and returns its last result (``complete``) or all results (``append``).

    Each batch replaces its own folder, so a batch that runs twice counts once; state and offsets are in the shared folder, and go at
    the end, as do results that a later batch's replace.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        if mode == "complete" and last and last[0] != number:
            delete(spark, f"{base}/out/batch={last[0]}")
        last[:] = [number]

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    delete(spark, f"{base}/state")
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{base}/out/batch={last[0]}")
    return spark.read.schema(stream.schema).parquet(*[f"{base}/out/batch={i}" for i in range(last[0] + 1)])


def continued(stream: DataFrame, base: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream in append mode over all there is, from where the last run in ``base`` ended, and returns what all runs have put out.

    Each batch replaces its own folder, so a batch that runs twice counts once. ``settings`` hold for the run's state.
    """
    spark = stream.sparkSession
    with set_for(spark, settings or {}):
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        run = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")).start()
        run.awaitTermination()
    out = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(out).parquet(f"{base}/out").drop("batch")


def finished(stream: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream once over all there is and returns what it put out; its state and offsets go."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = continued(stream, base, settings)
    delete(spark, f"{base}/state")
    return out


def merged(stream: DataFrame, part: Callable[[DataFrame], DataFrame], whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream over all there is; ``part`` is what each batch comes to by itself, ``whole`` what all of these come to.

    For aggregates that can be put together from parts: no state is kept between batches, and none writes anew what an earlier one has written. Each
    batch replaces its own folder, so a batch that runs twice counts once.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    keep = lambda batch, number: part(batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")
    run = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    delete(spark, f"{base}/state")
    schema = part(spark.createDataFrame([], stream.schema)).schema
    spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out").getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out"))
    return whole(spark.read.schema(schema.add("batch", LongType())).parquet(f"{base}/out").drop("batch"))


@contextmanager
def set_for(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for as long as they are needed."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def job_states(events: DataFrame) -> DataFrame:
    """The newest status of each job and the number of its events. ``events``: job_id, ts, event_id, status."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n_events"))


def feedback_stats(rows: DataFrame) -> DataFrame:
    """Counts of the feedback that came in so far."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("positive"))


def windowed(events: DataFrame, width: str, late: str, step: str | None = None) -> DataFrame:
    """Events by type in windows of event time, which overlap if a ``step`` is given; later ones than ``late`` are dropped. Not in the reference."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", width, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def first_mentions(words: DataFrame) -> DataFrame:
    """Where each document mentions each term for the first time (doc_id, term, at): a minimum for each, however the mentions arrive."""
    return words.groupBy("doc_id", "term").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))


def first_of_parts(mentions: DataFrame) -> DataFrame:
    """The same from what ``first_mentions`` found in parts of the words."""
    return mentions.groupBy("doc_id", "term").agg(F.min("first_at").alias("first_at"), F.sum("n").alias("n"))


def first_of_each(rows: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first arrival of each key within the watermark: what makes a repeated flush harmless."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
