"""Layout of pages from spans: measures, roles, alignment, overlaps, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ratios of a size to the median, and the tolerance of alignment in points.
TITLE, HEADING, FOOTNOTE, TOLERANCE = 1.35, 1.08, 0.85, 12


def percentiles(rows: DataFrame, key: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact percentiles (name -> column and share) of each key, between two values by their distance, from sorted counts of the distinct values.

    No task holds a key's values: equal ones are counted before they are shuffled, and a window sorts the rest, on disk if it must. Nulls count for nothing.
    """
    columns = sorted({c for c, _ in wanted.values()})
    values = rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")).select(key, "v.*").where("value IS NOT NULL")
    counts = values.groupBy(key, "of", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy(key, "of").orderBy("value")
    totals = counts.groupBy(key, "of").agg(F.sum("n").alias("total"))
    placed = counts.withColumn("until", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(totals, [key, "of"])
    holds = lambda at: (F.col("until") - F.col("n") <= at) & (at < F.col("until"))
    out = []
    for name, (column, share) in wanted.items():
        place = F.lit(share) * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        own = F.col("of") == column
        first, last = F.max(F.when(own & holds(low), F.col("value"))), F.max(F.when(own & holds(high), F.col("value")))
        part = F.max(F.when(own, place - low))
        out.append((first + (last - first) * part).alias(name))
    return placed.groupBy(key).agg(*out)


def page_measures(spans: DataFrame) -> DataFrame:
    """Median size and margins of each page: 5th percentile of the left ends, 95th of the right ends."""
    found = percentiles(spans, "page", {"median_size": ("size", 0.5), "left_margin": ("x0", 0.05), "right_margin": ("x1", 0.95)})
    return found.select("page", *[F.round(c, 6).alias(c) for c in ("median_size", "left_margin", "right_margin")])


def classified(spans: DataFrame, measures: DataFrame) -> DataFrame:
    """Spans with ``role`` and ``align``."""
    rows = spans.join(measures, "page")
    ratio = F.col("size") / F.col("median_size")
    left, right = F.col("x0") - F.col("left_margin"), F.col("right_margin") - F.col("x1")
    role = F.when(ratio >= TITLE, "title").when(ratio >= HEADING, "heading").when(ratio <= FOOTNOTE, "footnote").otherwise("body")
    align = F.when((F.abs(left - right) <= TOLERANCE) & (left > TOLERANCE), "center").when((right <= TOLERANCE) & (left > TOLERANCE), "right").otherwise("left")
    return rows.withColumns({"role": role, "align": align})


def overlapping(boxes: DataFrame, others: DataFrame, key: str, cell: int) -> DataFrame:
    """Pairs of overlapping boxes (x0, x1, y0, y1) of one key.

    Both are dealt to the grid cells they touch and meet there; a pair counts in the cell of its common upper left corner.
    """

    def dealt(rows: DataFrame, names: list[str]) -> DataFrame:
        x0, x1, y0, y1 = (F.floor(F.col(n) / cell) for n in names)
        return rows.withColumn("cx", F.explode(F.sequence(x0, x1))).withColumn("cy", F.explode(F.sequence(y0, y1)))

    right = others.withColumnsRenamed({n: f"o_{n}" for n in ("x0", "x1", "y0", "y1")})
    met = dealt(boxes, ["x0", "x1", "y0", "y1"]).join(dealt(right, ["o_x0", "o_x1", "o_y0", "o_y1"]), [key, "cx", "cy"])
    met = met.where("x0 < o_x1 AND o_x0 < x1 AND y0 < o_y1 AND o_y0 < y1")
    corner = (F.floor(F.greatest("x0", "o_x0") / cell) == F.col("cx")) & (F.floor(F.greatest("y0", "o_y0") / cell) == F.col("cy"))
    return met.where(corner).drop("cx", "cy")


def clamped(x: Column) -> Column:
    """Between 0 and 1."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def header_zone(rows: DataFrame, group: str, order: str, anchor: str) -> DataFrame:
    """Whether each row comes before the group's first anchor, or is it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("in_header", ~F.coalesce(F.bool_or(anchor).over(w), F.lit(False)))


def with_next(rows: DataFrame, group: str, order: list[str], column: str, name: str) -> DataFrame:
    """The next row's value, by which an extent ends."""
    return rows.withColumn(name, F.lead(column).over(Window.partitionBy(group).orderBy(*order)))


def without_adjacent_repeats(rows: DataFrame, group: str, order: str, text: str, least: int = 4) -> DataFrame:
    """Rows but those of over ``least`` characters that say the same as the one before."""
    norm = F.lower(F.trim(text))
    before = F.lag(norm).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("__before", before).where((F.length(text) <= least) | F.col("__before").isNull() | (F.col("__before") != norm)).drop("__before")


def with_previous(rows: DataFrame, group: str, order: list[str], column: str, name: str) -> DataFrame:
    """The value of the row before, null for the first."""
    return rows.withColumn(name, F.lag(column).over(Window.partitionBy(group).orderBy(*order)))
