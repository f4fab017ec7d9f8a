"""What of a document is to be translated, by its place, and its translation written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<text string, bold boolean, italic boolean>"
BLOCK = f"doc_id long, page int, block int, kind string, spans array<{SPAN}>, left array<{SPAN}>, right array<{SPAN}>, cells array<array<array<{SPAN}>>>"


def sides(kind: Column, spans: Column, left: Column, right: Column, cells: Column) -> Column:
    """The spans of a block's sides with their names: of a text its own, of a row both, of a table each cell's (``cell:row:column``)."""
    named = lambda side, own: F.struct(side.alias("side"), own.alias("spans"))
    of_row = lambda row, i: F.transform(row, lambda cell, k: named(F.format_string("cell:%d:%d", i, k), cell))
    table = F.flatten(F.transform(cells, of_row))
    return F.when(kind == "row", F.array(named(F.lit("left"), left), named(F.lit("right"), right))).when(kind == "text", F.array(named(F.lit("spans"), spans))).when(kind == "table", table)


def majority(spans: Column, flag: str) -> Column:
    """Whether over half the characters have a flag."""
    size = lambda own: F.aggregate(own, F.lit(0), lambda n, s: n + F.length(s["text"]))
    return size(F.filter(spans, lambda s: F.coalesce(s[flag], F.lit(False)))) / F.greatest(F.lit(1), size(spans)) > 0.5


def references(blocks: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``block``, ``side``, ``text`` (its spans joined), ``bold`` and ``italic``: a row for each side of each block.

    Blocks of other kinds, and sides that are null, have none.
    """
    rows = blocks.select("doc_id", "page", "block", F.explode(sides(*map(F.col, ("kind", "spans", "left", "right", "cells")))).alias("s")).where("s.spans IS NOT NULL")
    own = F.col("s.spans")
    return rows.select("doc_id", "page", "block", "s.side", F.array_join(F.transform(own, lambda s: s["text"]), "").alias("text"), majority(own, "bold").alias("bold"), majority(own, "italic").alias("italic"))


def written_back(blocks: DataFrame, translated: DataFrame) -> DataFrame:
    """The blocks with each side as one span of its translation (doc_id, page, block, side, text, bold, italic); a side without one stays.

    The sides of a block meet it as one map; a block is never larger than its own text.
    """
    key = ["doc_id", "page", "block"]
    span = F.struct("text", "bold", "italic").cast(SPAN)
    by_side = translated.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("side", F.array(span)))).alias("new"))
    rows = blocks.join(by_side, key, "left")
    given = lambda side, own: F.coalesce(F.element_at("new", side), own)
    cells = F.transform("cells", lambda row, i: F.transform(row, lambda cell, k: given(F.format_string("cell:%d:%d", i, k), cell)))
    is_kind = lambda k, new, old: F.when(F.col("kind") == k, new).otherwise(old)
    simple = {c: is_kind(k, F.when(F.col(c).isNotNull(), given(F.lit(c), F.col(c))), F.col(c)) for k, c in (("text", "spans"), ("row", "left"), ("row", "right"))}
    return rows.withColumns(simple | {"cells": is_kind("table", cells, F.col("cells"))}).drop("new")
