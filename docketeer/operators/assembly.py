"""Lines of a block put together: rows of two columns, texts of what follows one another; sections behind their headers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.operators.scans import running_total

# Fixed values, in points: lines whose middles are nearer than this share a row, and how far a column may reach over the page's middle.
SAME_ROW, TOLERANCE = 6.0, 12.0
ITEM = "page long, block long, item int, kind string, text string, left string, right string, x0 double, y0 double, x1 double, y1 double, size double"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
PART = 4096


def merged(texts: list[str]) -> str:
    """The lines' texts with a space between two that have none there."""
    out = ""
    for text in texts:
        out += (" " if out and not out.endswith(" ") and not text.startswith(" ") else "") + text
    return out


def items(lines: list[tuple], width: float) -> Iterator[tuple]:
    """Items of a block from its lines (page, block, n, x0, y0, x1, y1, size, text), which are in order."""
    rows: list[list] = []  # the lines of one height, and the sum of their middles
    for line in lines:
        if line[8]:
            middle = (line[4] + line[6]) / 2
            row = next((r for r in reversed(rows) if abs(middle - r[1] / len(r[0])) < SAME_ROW), None)
            if row is None:
                rows.append(row := [[], 0.0])
            row[0].append(line)
            row[1] += middle
    n, half = 0, width / 2
    pending: list[tuple] = []

    def item(kind: str, own: list[tuple], *texts: str | None) -> tuple:
        nonlocal n
        n += 1
        _, _, _, x0, y0, x1, y1, sizes, _ = zip(*own)
        return (*own[0][:2], n - 1, kind, *texts, min(x0), min(y0), max(x1), max(y1), max(sizes) if kind == "text" else None)

    text_of = lambda own: merged([x[8] for x in own])
    for own, _ in rows:
        left = [x for x in own if x[5] <= half + TOLERANCE] if len(own) > 1 else []
        right = [x for x in own if x[3] >= half - TOLERANCE] if left else []
        if right and max(x[5] for x in left) < min(x[3] for x in right):
            if pending:
                yield item("text", pending, text_of(pending), None, None)
                pending = []
            yield item("row", own, None, text_of(left), text_of(right))
        else:
            pending += own
    if pending:
        yield item("text", pending, text_of(pending), None, None)


def assembled(lines: DataFrame, width: float) -> DataFrame:
    """The items of every block: rows of a left and a right column where the lines of one height leave a gap at the page's middle, else texts.

    Blocks are dealt and sorted; each partition's lines go through once, in parts of Arrow batches, and a block is held, no more.
    """
    rows = lines.select("page", "block", "n", "x0", "y0", "x1", "y1", "size", "text")
    kinds = pa.schema([(name, KINDS[kind]) for name, kind in (field.split() for field in ITEM.split(", "))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines_ = (line for b in batches for i in range(0, b.num_rows, PART) for line in zip(*(c.to_pylist() for c in b.slice(i, PART).columns)))
        out = (item for _, own in groupby(lines_, key=lambda line: line[:2]) for item in items(list(own), width))
        while part := list(islice(out, PART)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds.types)], schema=kinds)

    return rows.repartition("page", "block").sortWithinPartitions("page", "block", "n").mapInArrow(found, ITEM)


def sections(lines: DataFrame, doc: str, order: str, text: str, header: Column) -> DataFrame:
    """``doc``, ``section``, ``title`` and ``content``: the lines behind each header up to the next; what comes before the first has number 0 and no title.

    Documents of any number of lines; a section's lines are joined, so it is held whole.
    """
    begins = F.coalesce(header, F.lit(False))
    rows = running_total(lines.withColumn("__header", begins), doc, [order], begins.cast("int"), "section")
    rows = rows.withColumn("section", F.col("section") + F.col("__header").cast("int"))
    own = F.array_sort(F.collect_list(F.when(~F.col("__header"), F.struct(order, text))))
    out = rows.groupBy(doc, "section").agg(F.max(F.when(F.col("__header"), F.col(text))).alias("title"), own.alias("own"))
    return out.select(doc, "section", "title", F.array_join(F.transform("own", lambda x: x[text]), "\n").alias("content"))
