"""Chunks of documents. The folds depend on order within a document, so each runs on whole texts, a part of an Arrow batch at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.functions import legal
from docketeer.functions.batches import by_parts

# Sizes of paragraphs and of pieces for translation, and where texts divide.
LEAST_PARAGRAPH, MOST_PARAGRAPH, MOST_PIECE = 80, 1200, 1800
BLANK_LINE = re.compile(r"\n\s*\n")
ITEM_START = re.compile(r"(?m)(?=^\s*(?:\d{1,2}[.)]\s|[a-z][.)]\s|\([a-zA-Z0-9]{1,2}\)\s))")
SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+(?=[A-Z(])")
ISOLATED_ROLES = ("title", "heading", "table")


def gathered(parts: Iterable[str], most: int, joint: str = " ") -> list[str]:
    """Neighbours joined as long as they stay within ``most`` characters; longer ones stand alone."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(joint) + len(part) <= most:
            out[-1] += joint + part
        else:
            out.append(part)
    return out


def paragraphs(text: str | None, least: int = LEAST_PARAGRAPH, most: int = MOST_PARAGRAPH) -> list[str]:
    """Paragraphs of a legal text: at blank lines and numbered items, short ones joined on, long ones cut at sentences."""
    units = [p.strip() for block in BLANK_LINE.split(text or "") for p in ITEM_START.split(block.strip())]
    joined: list[str] = []
    pending = ""
    for unit in filter(None, units):
        pending = f"{pending} {unit}".strip()
        if len(pending) >= least:
            joined.append(pending)
            pending = ""
    if pending:  # what is left at the end is too short for itself
        joined[-1:] = [f"{joined[-1]} {pending}" if joined else pending]
    return [piece for p in joined for piece in ([p] if len(p) <= most else [s.strip() for s in gathered(SENTENCE_GAP.split(p), most)])]


def pieces(text: str | None, most: int = MOST_PIECE) -> list[str]:
    """Pieces of at most ``most`` characters that together are the text; cut after a line, a sentence, or where it must be."""
    out, rest = [], text or ""
    while len(rest) > most:
        window = rest[:most]
        cut = window.rfind("\n") + 1 or max(window.rfind(mark) for mark in (". ", "? ", "! ", "। ")) + 1 or most
        out.append(rest[:cut])
        rest = rest[cut:]
    return [*out, rest] if rest else out


def packed(texts: list[str], roles: list[str], most: int) -> list[list[int]]:
    """Regions in batches of at most ``most`` characters, in order: isolated roles alone, footnotes with footnotes only."""
    batches: list[list[int]] = []
    size, kind = 0, ""
    for i, (text, role) in enumerate(zip(texts, roles)):
        own = "footnote" if role == "footnote" else role if role in ISOLATED_ROLES else "body"
        if not batches or own in ISOLATED_ROLES or own != kind or size + len(text) > most:
            batches.append([])
            size, kind = 0, own
        batches[-1].append(i)
        size += len(text)
    return batches


def exploded(docs: DataFrame, split: Callable[[str | None], list[str]], text_col: str = "text") -> DataFrame:
    """A row for each part that ``split`` gives, numbered ``n`` from 1; documents without parts have none."""
    parts = by_parts(split, "array<string>", pa.list_(pa.string()))
    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, F.posexplode(parts(F.col(text_col))).alias("n", "chunk")).withColumn("n", F.col("n") + 1)


def legal_chunks(docs: DataFrame) -> DataFrame:
    """Paragraph chunks with id, kind, terms and flags. ``docs``: doc_id, text."""
    rows = exploded(docs.select("doc_id", "text"), paragraphs)
    return rows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_p"), F.col("n").cast("string")).alias("chunk_id"), "doc_id", "n", "chunk",
        legal.paragraph_kind(F.col("chunk")).alias("kind"), F.array_join(legal.key_terms(F.col("chunk")), "|").alias("key_terms"), F.col("chunk").rlike(legal.DIAGRAM).alias("has_diagram"),
    )


def sliding(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters that overlap; the last one may be shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substr(text, s, F.lit(size)))
