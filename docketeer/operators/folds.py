"""Folds over ordered groups as table functions: a row goes through as it arrives, so a group is never held."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from docketeer.operators.chunking import ISOLATED_ROLES


class PackedRegions:
    """Numbers the batches of a group's regions: at most so many characters, isolated roles alone, footnotes with footnotes only."""

    def __init__(self) -> None:
        self.batch, self.size, self.kind = -1, 0, ""

    @staticmethod
    def analyze(regions: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not regions.isTable:
            raise ValueError("the regions must be a table")
        known = {f.name: f.dataType for f in regions.dataType.fields}
        missing = {"doc", "place", "role", "text"} - known.keys()
        if missing:
            raise ValueError(f"the regions lack {', '.join(sorted(missing))}")
        schema = StructType().add("doc", known["doc"]).add("place", known["place"]).add("batch", IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc")], orderBy=[OrderingColumn("place")])

    def eval(self, region: Row, most: int) -> Iterator[tuple]:
        own = "footnote" if region["role"] == "footnote" else region["role"] if region["role"] in ISOLATED_ROLES else "body"
        length = len(region["text"] or "")
        if self.batch < 0 or own in ISOLATED_ROLES or own != self.kind or self.size + length > most:
            self.batch, self.size, self.kind = self.batch + 1, 0, own
        self.size += length
        yield region["doc"], region["place"], self.batch


packed_regions = F.udtf(PackedRegions)


def packed(regions: DataFrame, most: int) -> DataFrame:
    """``doc``, ``place`` and ``batch`` of every region (doc, place, role, text); the function says itself how the table is to be dealt and sorted."""
    return packed_regions(regions.select("doc", "place", "role", "text").asTable(), F.lit(most))


class FixedWindows:
    """Pieces of a text of fixed size with an overlap, one after the other."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not 0 <= overlap.value < size.value:
            raise ValueError("the overlap must be smaller than the size")
        known = {f.name: f.dataType for f in docs.dataType.fields}
        return AnalyzeResult(StructType().add("doc", known["doc"]).add("start", LongType()).add("chunk", StringType()))

    def eval(self, row: Row, size: int, overlap: int) -> Iterator[tuple]:
        text = row["text"] or ""
        for start in range(0, max(len(text) - overlap, 1), size - overlap):
            yield row["doc"], start, text[start : start + size]


fixed_windows = F.udtf(FixedWindows)
