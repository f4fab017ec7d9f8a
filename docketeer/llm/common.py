"""What the training-data operators share: saved tables, and batches of texts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.sources.shared import delete, shared_folder
from docketeer.sources.tables import spread, table

__all__ = ["crc", "delete", "discard", "documents", "gathered", "kept_by_worker", "let", "parts_of", "save", "setting", "shared_folder", "spread", "table"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


#: Shuffle files go as soon as the query that wrote them ends, where Spark knows the setting.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as it is needed."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def save(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again: later steps neither recompute it nor lose it with an executor.

    The shuffles behind it are of no more use then, and are removed.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """The same rows in as few parts as hold ``most`` each: a small table needn't be written as hundreds of files. ``rows`` bounds their number."""
    return df.coalesce(max(1, -(-rows // most)))


def discard(*tables: DataFrame) -> None:
    """Deletes what ``save`` wrote, once nothing will read it again. Each table reads saved ones only; no files are listed for it."""
    for df in tables:
        for folder in sorted(folders_of(df)):
            if not re.search(r"/[0-9a-f]{32}$", folder):  # the names that save gives
                raise ValueError(f"{folder} is no saved table")
            delete(df.sparkSession, folder)


def folders_of(df: DataFrame) -> set[str]:
    """The folders that a table is read from."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation":
            paths = leaves.apply(i).relation().location().rootPaths()
            found |= {paths.apply(k).toString() for k in range(paths.size())}
    return found


def parts_of(batches: Iterable[pa.RecordBatch], at: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batches in parts with about ``most`` bytes of text each, and the texts, which are in column ``at``.

    So a task never has more texts in Python than a part's, or one very long one.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = done = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            part = batch.slice(start, end - start)
            yield part, part.column(at).to_pylist()
            start, done = end, int(ends[end - 1])


_kept: dict[tuple[str, Any], Any] = {}


def kept_by_worker(operator: str, key: Any, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing at a time, so that the stages of a pipeline don't add up."""
    if (operator, key) not in _kept:
        _kept.clear()
        _kept[operator, key] = build()
    return _kept[operator, key]


def crc(column: Column) -> Column:
    """CRC-32 of an id written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
