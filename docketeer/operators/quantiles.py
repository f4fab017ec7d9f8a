"""Quantiles as sketches that merge: kept for each page, put together for files and collections without reading the spans again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 200  # of a sketch; the rank of a quantile is off by less than RANK_ERROR with a probability of 99 %
RANK_ERROR = 0.0133


def sketched(rows: DataFrame, keys: list[str], columns: list[str], k: int = K) -> DataFrame:
    """A KLL sketch of each column for each key, a few kilobytes however many rows the key has. Nulls are left out; parts of a key are merged."""
    return rows.groupBy(*keys).agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(c) for c in columns])


def merged(sketches: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The sketches of coarser keys, from those of finer ones."""
    return sketches.groupBy(*keys).agg(*[F.kll_merge_agg_double(c).alias(c) for c in columns])


def measures(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Number, median size and margins of each key: 5th percentile of the left ends, 95th of the right ends."""
    at = lambda c, q: F.kll_sketch_get_quantile_double(c, F.lit(q))
    return sketches.select(*keys, F.kll_sketch_get_n_double("size").alias("n"), at("size", 0.5).alias("median_size"), at("x0", 0.05).alias("left_margin"), at("x1", 0.95).alias("right_margin"))
