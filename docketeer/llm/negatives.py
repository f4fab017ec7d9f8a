"""Hard negatives: the best rows of other labels that score well below an anchor's positives, found through a table of pivot distances."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketeer.llm.common import discard, save

TILE = 128  # rows that are bracketed, and checked, together
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
NO_ID = MOST  # stands for a null id, so that it is last among ties


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros to the longest one's length."""
    out = np.zeros((len(vectors), width), np.int64)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == NO_ID)


@dataclass
class Space:
    """Vectors x become (x, sqrt(M - x.x)) and anchors q become (q, 0), M being the largest x.x: their distance is sqrt(q.q + M - 2 q.x).

    So a score is large where a distance is small, and distances obey the triangle inequality, which inner products don't.
    """

    width: int
    most: float  # M
    exact: bool  # whether sums of products fit a float without rounding
    pivots: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    @property
    def slack(self) -> float:
        """More than rounding can change a distance by."""
        return 1e-6 * (1 + self.most**0.5)

    def numbers(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64 if self.exact else np.int64)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        y = x.astype(np.float64)
        return np.column_stack([y, np.sqrt(np.maximum(0, self.most - (y * y).sum(1)))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Of points of the larger space (rows) from the pivots (columns)."""
        squares = (points * points).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(0, squares))

    def with_pivots(self, x: np.ndarray, n: int) -> Space:
        """Pivots that lie far apart: each the farthest from those before it, of the given rows."""
        points = self.augmented(x)
        chosen = points[:1]
        near = np.full(len(points), np.inf)
        while 0 < len(chosen) < n:
            near = np.minimum(near, np.sqrt(((points - chosen[-1]) ** 2).sum(1)))
            if near.max() <= self.slack:
                break
            chosen = np.vstack([chosen, points[near.argmax()]])
        return Space(self.width, self.most, self.exact, chosen)


@dataclass
class Rows:
    """Some rows of the table."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    distance: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, space: Space) -> Rows:
        # one array a column, also where a table has its columns in pieces
        get = lambda name: c.combine_chunks() if isinstance(c := batch.column(batch.schema.get_field_index(name)), pa.ChunkedArray) else c
        n = batch.num_rows
        return cls(
            get("row").to_numpy(zero_copy_only=False), ids_of(get("id")), get("label").to_numpy(zero_copy_only=False),
            space.numbers(np.frombuffer(b"".join(get("x").to_pylist()), np.int64).reshape(n, space.width)),
            np.frombuffer(b"".join(get("distance").to_pylist()), np.float64).reshape(n, len(space.pivots)),
        )

    def cut(self, start: int, end: int) -> Rows:
        return Rows(self.row[start:end], self.id[start:end], self.label[start:end], self.x[start:end], self.distance[start:end])


@dataclass
class Asked:
    """Anchors, and queries of them: the best ``k`` rows of the same label, or of other ones, with a score in a window."""

    anchors: Rows
    same: bool
    k: int
    anchor: np.ndarray  # of each query; an anchor's queries are neighbours
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray  # a score that the last of a query's best reaches at least

    def __post_init__(self) -> None:
        self.first = np.searchsorted(self.anchor, np.arange(len(self.anchors.id)))
        self.queries = np.bincount(self.anchor, minlength=len(self.anchors.id))


class Best:
    """The best rows of each query so far."""

    def __init__(self, asked: Asked, space: Space) -> None:
        self.asked, self.space = asked, space
        self.seen = self.checked = 0  # pairs of anchor and row: all, and those that were scored
        self.last = asked.least.copy()
        self.last_id = np.full(len(asked.anchor), MOST)
        none = np.zeros(0, np.int64)
        self.held, self.new, self.n_new = (none, none, none), [], 0
        floats = asked.anchors.x.astype(np.float64)
        self.reach = (floats * floats).sum(1) + space.most
        self.from_pivots = space.distances(np.column_stack([floats, np.zeros(len(floats))]))
        self._narrow()

    def _narrow(self) -> None:
        """Which scores can still matter to an anchor, and so which distances."""
        asked, n = self.asked, len(self.asked.anchors.id)
        self.need = np.full(n, MOST)
        most = np.full(n, LEAST)
        np.minimum.at(self.need, asked.anchor, np.maximum(asked.low, self.last))
        np.maximum.at(most, asked.anchor, asked.high)
        self.farthest = np.sqrt(np.maximum(0, self.reach - 2.0 * self.need)) + self.space.slack
        self.nearest = np.sqrt(np.maximum(0, self.reach - 2.0 * most)) - self.space.slack

    def see(self, rows: Rows) -> None:
        for start in range(0, len(rows.id), TILE):
            self._see(rows.cut(start, start + TILE))

    def _see(self, tile: Rows) -> None:
        """Brackets the tile's distance from each anchor by the triangle inequality, and scores it for those that it can matter to."""
        asked, low, high = self.asked, tile.distance.min(0), tile.distance.max(0)
        below = np.maximum(low - self.from_pivots, self.from_pivots - high).max(1, initial=0)
        above = (self.from_pivots + high).min(1, initial=np.inf)
        alive = np.flatnonzero((below <= self.farthest) & (above >= self.nearest) & (asked.queries > 0))
        self.seen += len(asked.anchors.id) * len(tile.id)
        for k in range(0, len(alive), 2048):
            a = alive[k : k + 2048]
            self.checked += len(a) * len(tile.id)
            scores = asked.anchors.x[a] @ tile.x.T
            matter = (scores >= self.need[a][:, None]) & ((asked.anchors.label[a][:, None] == tile.label) == asked.same)
            i, j = np.nonzero(matter)
            apart = asked.anchors.row[a[i]] != tile.row[j]
            i, j = i[apart], j[apart]
            score, ids = scores[i, j].astype(np.int64), tile.id[j]
            for p in range(int(asked.queries[a[i]].max(initial=0))):
                has = np.flatnonzero(asked.queries[a[i]] > p)
                q, s, d = asked.first[a[i[has]]] + p, score[has], ids[has]
                good = (s >= asked.low[q]) & (s <= asked.high[q]) & ((s > self.last[q]) | ((s == self.last[q]) & (d <= self.last_id[q])))
                if good.any():
                    self.new.append((q[good], s[good], d[good]))
                    self.n_new += int(good.sum())
            if self.n_new > 1 << 17:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and id of the best so far; ties go to the smaller id."""
        q, s, d = (np.concatenate(x) for x in zip(self.held, *self.new))
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.asked.k
        self.held, self.new, self.n_new = (q[kept], s[kept], d[kept]), [], 0
        full = rank == self.asked.k - 1
        # an earlier bound on the score may be better, and then says nothing of ids
        better = s[full] >= self.last[q[full]]
        at = q[full][better]
        self.last[at], self.last_id[at] = s[full][better], d[full][better]
        self._narrow()
        return self.held


def pivot_table(rows: DataFrame, pivots: int, sample: int) -> tuple[DataFrame, Space]:
    """The rows with their distances from the pivots, those near the same pivot side by side in order of their distance from it."""
    spark = rows.sparkSession
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = rows.withColumn("square", square)
    stats = rows.agg(F.max("square").alias("most"), F.max(F.size("vector")).alias("width")).first()
    space = Space(max(1, stats.width or 0), stats.most or 0.0, (stats.most or 0.0) < 2.0**52)
    some = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    space = space.with_pivots(matrix(some, space.width), pivots)
    shared = spark.sparkContext.broadcast(space)  # a handful of vectors

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value
            x = matrix(batch.column(2), s.width)
            d = s.distances(s.augmented(x))
            near = d.argmin(1)
            columns = [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(near), pa.array(d[np.arange(len(x)), near]), pa.array([r.tobytes() for r in d], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "x", "near", "by", "distance"])

    measured = rows.select("id", "label", "vector").mapInArrow(run, "id long, label long, x binary, near long, by double, distance binary")
    # with the id, so that a large group of equal vectors is divided, and comes in the order that ties go by
    laid = measured.repartitionByRange("near", "by", "id").sortWithinPartitions("near", "by", F.col("id").asc_nulls_last())
    return save(laid.select("id", "label", "x", "distance").withColumn("row", F.monotonically_increasing_id())), space


def scanned(table: DataFrame, shared: Broadcast) -> DataFrame:
    """``query``, ``score``, ``id``: the best of each query in each part of the table, and of these the best of all, by ``rank``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, space = shared.value
        best = Best(asked, space)
        for batch in batches:
            if batch.num_rows:
                best.see(Rows.of(batch, space))
        q, s, d = best.settle()
        for k in range(0, len(q), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(q[part]), pa.array(s[part]), pa.array(d[part])], names=["query", "score", "id"])

    found = table.mapInArrow(run, "query long, score long, id long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shared.value[0].k)


def bounded(asked: Asked, space: Space, some: Rows) -> Asked:
    """The queries with what some rows of the table already say of their best scores."""
    best = Best(asked, space)
    best.see(some)
    best.settle()
    return Asked(asked.anchors, asked.same, asked.k, asked.anchor, asked.low, asked.high, best.last)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, pivots: int = 16, sample: int = 2048, chunk: int = 16_384) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` for the anchors among the rows.

    ``rows`` has ``id``, ``label`` and ``vector`` (array of whole numbers, which are scored by inner product). Anchors are the rows for which the
    column ``anchors`` of ``id`` is true. Their positives are the best other rows of their label; a positive's negatives the best rows of other labels
    whose score is from ``low`` to ``high`` percent of the positive's. Ties go to the smaller id.

    The table of distances from ``pivots`` rows (of a sample of ``sample``) is written once. Anchors go out in chunks of ``chunk``, which bounds
    what is broadcast, and each chunk's tasks read their part of the table: a tile whose distances from the pivots rule out that it
    can matter to an anchor isn't scored for it; all others are. The sample also gives each query a score to start from. Nothing is approximate.

    Rows with a null label or vector, or a null in the vector, take no part; a null id is no anchor, and last among ties. Shorter vectors
    count as filled up with zeros. Equal rows are different rows: each is an anchor, a positive and a negative of its own. Scores must fit
    a long. An anchor without positives, or a positive without negatives, has no row. Other columns are left. Empty tables give no rows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull()))
    table, space = pivot_table(rows, pivots, sample)
    some = Rows.of(table.orderBy(F.xxhash64("row"), "row").limit(sample).toArrow(), space)
    wanted = table.where(anchors)
    parts = -(-wanted.count() // chunk)
    asked = save(wanted.repartition(max(1, parts)).withColumn("chunk", F.spark_partition_id()))
    found = []
    for i in range(parts):
        at = Rows.of(asked.where(F.col("chunk") == i).toArrow(), space)
        every = np.arange(len(at.id))
        of_label = Asked(at, True, positives, every, np.full(len(every), LEAST), np.full(len(every), MOST), np.full(len(every), LEAST))
        shared = spark.sparkContext.broadcast((bounded(of_label, space, some), space))
        best = sorted((r.query, r["rank"], r.id, r.score) for r in scanned(table, shared).collect())  # a few of each anchor in the chunk
        shared.unpersist()
        anchor, _, positive, score = (np.array(c, np.int64) for c in zip(*best)) if best else np.zeros((4, 0), np.int64)
        least, most = -(-(low * score) // 100), high * score // 100
        others = bounded(Asked(at, False, negatives, anchor, least, most, np.full(len(anchor), LEAST)), space, some)
        shared = spark.sparkContext.broadcast((others, space))
        names = spark.sparkContext.broadcast((at.id[anchor], positive, score))
        found.append(save(named(scanned(table, shared), names)))
        shared.unpersist()
    discard(asked, table)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for part in found:
        out = out.unionByName(part)
    return out


def named(best: DataFrame, names: Broadcast) -> DataFrame:
    """The best rows with the ids that their queries stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, positive, score = names.value
        for batch in batches:
            q = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [id_array(anchor[q]), id_array(positive[q]), batch.column(3), id_array(batch.column(2).to_numpy()), pa.array(score[q]), batch.column(1)],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return best.select("query", "score", "id", "rank").mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
