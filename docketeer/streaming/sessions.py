"""Sessions of events, and answers joined to the calls before them, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's events with no pause of ``gap`` between them. Events out of order may extend or merge sessions, later ones than ``late`` don't.

    ``events``: the key, ts and value. A session comes out once the watermark has passed its end, which is a gap after its last event; until then
    only its bounds and totals are kept.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = timed.groupBy(key, F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(key, F.col("s.start").cast("timestamp_ntz").alias("started"), F.col("s.end").cast("timestamp_ntz").alias("ended"), "n", F.round("total", 4).alias("total"))


def answered(calls: DataFrame, results: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """Every call with the results of its key that come within a time after it, and calls without any once none can come any more.

    Both have the key, an ``id`` and ts. The watermarks and the time bound what either side keeps.
    """
    left = calls.select(F.col(key), F.col("id").alias("call_id"), F.col("ts").cast("timestamp").alias("called")).withWatermark("called", late)
    right = results.select(F.col(key).alias("__key"), F.col("id").alias("result_id"), F.col("ts").cast("timestamp").alias("returned")).withWatermark("returned", late)
    met = F.expr(f"{key} = __key AND returned >= called AND returned <= called + INTERVAL {within}")
    return left.join(right, met, "leftOuter").drop("__key")
