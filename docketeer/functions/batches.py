"""Python functions of whole values, a part of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 1 << 20


def sizes(values: pa.Array) -> np.ndarray:
    """About how many bytes each value has, strings in lists included."""
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        ends = np.append(0, np.cumsum(sizes(values.values) + 8))
        offsets = values.offsets.to_numpy()
        return ends[offsets[1:]] - ends[offsets[:-1]]
    if pa.types.is_struct(values.type):
        return sum(sizes(values.field(i)) for i in range(values.type.num_fields))
    if not (pa.types.is_string(values.type) or pa.types.is_large_string(values.type)):
        return np.full(len(values), 8)
    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def parts(columns: tuple[pa.Array, ...], most: int = MOST_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """The rows in parts of about ``most`` bytes, or of one very long row."""
    rows = len(columns[0])
    ends = np.cumsum(sum(sizes(c) for c in columns) + 1)
    start = done = 0
    while start < rows:
        end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield tuple(c.slice(start, end - start) for c in columns)
        start, done = end, int(ends[end - 1])


def by_parts(of: Callable[..., Any], returns: str, kind: pa.DataType) -> Callable[..., Column]:
    """``of`` for each row of one or more columns (texts, or lists of texts). Python never has more of a batch than a part as its own objects."""

    @F.arrow_udf(returns)
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield pa.array([], kind)
            for (own,) in parts((batch,)):
                yield pa.array([of(x) for x in own.to_pylist()], kind)

    @F.arrow_udf(returns)
    def both(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch[0]):
                yield pa.array([], kind)
            for a, b in parts(batch):
                yield pa.array([of(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

    return lambda *columns: (each if len(columns) == 1 else both)(*columns)


def of_texts(of: Callable[[str], str]) -> Callable[[Column], Column]:
    """The same for a text that becomes another; null stays null."""
    return by_parts(lambda t: of(t) if t is not None else None, "string", pa.string())
