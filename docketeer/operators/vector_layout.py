"""Vectors written by cell, and searches that leave out the cells that the triangle inequality rules out."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketeer.functions.vectors import cosine_distance, dot, literal, norm

#: The cell of vectors without a direction (null, of no length, or not finite). The similarity of null vectors to anything counts as 0.
NOWHERE = -1
SLACK = 1e-6  # more than rounding changes an angle by


@dataclass(frozen=True)
class Cell:
    cell: int
    nearest: float  # the least and the largest angle of its vectors from its centre
    farthest: float
    n: int
    centre: list[float]


def unit(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double") / norm(vector))


def angle(a: Column, b: Column) -> Column:
    """Between two unit vectors."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def direction(centre: list[float]) -> list[float]:
    """A centre as a unit vector; where opposite vectors cancel out, any will do, as bounds hold from any direction."""
    length = math.sqrt(sum(x * x for x in centre))
    return [x / length for x in centre] if length else [1.0] + [0.0] * (len(centre) - 1)


def write_cells(vectors: DataFrame, path: str, cells: int = 64, sample: int = 20_000, vector: str = "embedding") -> None:
    """Writes the rows by cell, those of a cell in the order of their angle from its centre, and a table of the cells.

    The centres come from k-means on a sample (its size is ``sample``); every row is in the cell of its nearest centre. The rows are dealt by
    ranges of cell and angle, so a large cell is in several files. The table of the cells has ``cells`` rows at most.
    """
    spark = vectors.sparkSession
    has_direction = F.coalesce((norm(F.col(vector)) > 0) & (norm(F.col(vector)) < float("inf")), F.lit(False))
    pointed = vectors.where(has_direction).withColumn("__unit", unit(F.col(vector)))
    some = pointed.select("__unit", F.xxhash64("__unit").alias("draw")).dropDuplicates(["draw"]).orderBy("draw").limit(sample).select(array_to_vector("__unit").alias("v"))
    n = some.count()
    rows = vectors.where(~has_direction).withColumns({"cell": F.lit(NOWHERE), "angle": F.lit(math.pi / 2)})
    if n:
        if n > 1:  # as many different vectors as centres to begin with
            model = KMeans(k=min(cells, n), seed=42, maxIter=10, initMode="random", featuresCol="v", predictionCol="cell").fit(some)
            found, place = model.clusterCenters(), model.transform
        else:
            found, place = [some.first().v.toArray()], lambda rows: rows.withColumn("cell", F.lit(0))
        centres = [(i, direction([float(x) for x in c])) for i, c in enumerate(found)]
        table = F.broadcast(spark.createDataFrame(centres, "cell int, centre array<double>"))  # cells rows at most
        near = place(pointed.withColumn("v", array_to_vector("__unit"))).drop("v").join(table, "cell")
        near = near.withColumn("angle", angle(F.col("__unit"), F.col("centre")))
        rows = near.select(*rows.columns).unionByName(rows)
    laid = rows.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle")
    laid.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    # an empty table has no file that could tell its columns
    spark.createDataFrame([(laid.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    known = spark.read.schema(laid.schema).parquet(f"{path}/rows").groupBy("cell").agg(F.min("angle").alias("nearest"), F.max("angle").alias("farthest"), F.count("*").alias("n"))
    if not n:
        known = known.withColumn("centre", F.array().cast("array<double>"))
    else:
        known = known.join(table, "cell", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<double>")))
    known.write.mode("overwrite").parquet(f"{path}/cells")


class VectorLayout:
    """What ``write_cells`` wrote."""

    def __init__(self, spark: SparkSession, path: str, vector: str = "embedding") -> None:
        self.vector = vector
        schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first().value))
        self.rows = spark.read.schema(schema).parquet(f"{path}/rows")
        self.cells = [Cell(r.cell, r.nearest, r.farthest, r.n, list(r.centre)) for r in spark.read.parquet(f"{path}/cells").collect()]

    def away(self, cell: Cell, query: list[float]) -> float:
        """The query's angle from the cell's centre; the query is a unit vector."""
        return math.acos(max(-1.0, min(1.0, sum(a * b for a, b in zip(cell.centre, query)))))

    def bound(self, cell: Cell, query: list[float]) -> float:
        """No vector of the cell has a smaller angle from the query: angles obey the triangle inequality."""
        if not query or cell.cell == NOWHERE:
            return math.pi / 2
        own = self.away(cell, query)
        return max(0.0, own - cell.farthest, cell.nearest - own)

    def distances(self, rows: DataFrame, query: list[float]) -> DataFrame:
        far = F.coalesce(cosine_distance(F.col(self.vector), literal(query)), F.lit(1.0))
        return rows.withColumn("distance", F.round(far, 9))

    def within(self, cells: list[Cell], query: list[float], limit: float) -> DataFrame:
        """The rows of some cells that may be nearer than an angle: their own angle from the centre differs from the query's by less."""
        if not cells:
            return self.rows.where(F.lit(False))
        rows = self.rows.where(F.col("cell").isin([c.cell for c in cells]))
        if not query or limit >= math.pi:
            return rows
        ranges = [(F.col("cell") == c.cell) & F.col("angle").between(self.away(c, query) - limit - SLACK, self.away(c, query) + limit + SLACK) for c in cells if c.cell != NOWHERE]
        return rows.where(reduce(Column.__or__, ranges, F.col("cell") == NOWHERE))

    def search(self, vector: list[float], k: int, among: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The k rows nearest to the vector, of those that ``among`` (a filter or semi-join) keeps, with their ``distance``: what a scan of all gives.

        The cells nearest to it are read first, twice as many each time, until they hold k such rows. The k-th distance rules out those of the other
        cells whose bound lies beyond it, and in each cell the rows whose angle does; the rest is read. Ties go to the smaller ``id``.
        """
        length = math.sqrt(sum(x * x for x in vector))
        query = [x / length for x in vector] if length else []
        order = sorted(self.cells, key=lambda c: (self.bound(c, query), c.cell))
        limit, probed = math.pi, 0
        while probed < len(order):
            probed = min(len(order), max(1, 2 * probed))
            if sum(c.n for c in order[:probed]) < k:
                continue
            near = self.distances(among(self.rows.where(F.col("cell").isin([c.cell for c in order[:probed]]))), vector)
            found = near.orderBy("distance", "id").limit(k).agg(F.max("distance").alias("last"), F.count("*").alias("n")).first()
            if found.n >= k:
                limit = math.acos(max(-1.0, 1 - found.last - 1e-9)) + SLACK
                break
        needed = [c for c in order if self.bound(c, query) <= limit]
        rows = self.within(needed, query, limit)
        return self.distances(among(rows), vector).orderBy("distance", "id").limit(k)
