"""Repeated passages: windows of words are anchored at the places of a difference cover, and extended where anchors recur."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.llm.common import discard, parts_of, save
from docketeer.llm.simhash import looked_up

#: Period -> places such that any two numbers have a common distance, below the period, to the next pair of places modulo it. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
SPACE = re.compile(rb"[ \t-\r]")
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pieces(data: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, those of about ``most`` bytes at a time."""
    start = 0
    while start < len(data):
        end = start + most
        if end < len(data):
            cut = SPACE.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[start:end].split()  # of bytes: white space is ASCII's
        start = end


def word_hashes(text: str) -> np.ndarray:
    found = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in pieces(text.encode())]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of neighbours from the hashes of both, in this order."""
    x = (a ^ (a >> np.uint64(29))) * _FIRST + b
    x = (x ^ (x >> np.uint64(32))) * _SECOND
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each place on, put together from those of 1, 2, 4, ... words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at, size, power = None, 0, 1, words
    while True:
        if width & size:
            out = power[at : at + n] if out is None else joined(out, power[at : at + n])
            at += size
        if 2 * size > width:
            return out
        power, size = joined(power[:-size], power[size:]), 2 * size


def period_of(window: int) -> int:
    """Anchors get the rest of the window: fewer of them with a longer period, more telling ones with a shorter."""
    return max(p for p in COVERS if p <= max(1, window * 3 // 5))


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cover and the hashes of the windows there. Two texts that share ``window`` words share one of these, at the same distance."""
    period = period_of(window)
    hashes = window_hashes(words, window - period + 1)
    at = np.flatnonzero(np.isin(np.arange(len(hashes)) % period, COVERS[period])) if len(words) >= window else np.empty(0, np.int64)
    return at, hashes[at]


def extended(at: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Starts of the whole windows that hold one of the anchors at the given places."""
    last, reach = n_words - window, period_of(window) - 1
    steps = np.zeros(n_words + 2, np.int64)
    np.add.at(steps, np.maximum(0, at - reach), 1)
    np.add.at(steps, np.minimum(at, last) + 1, -1)
    return np.flatnonzero(np.cumsum(steps)[: last + 1] > 0)


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words the windows cover."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps)[:n_words] > 0


def kept_words(text: str, removed: np.ndarray | None) -> tuple[str, int]:
    """The words that stay, joined by one space, and how many there were. None removed: all stay."""
    out, n = [], 0
    for words in pieces(text.encode()):
        here = words if removed is None else [w for w, gone in zip(words, removed[n : n + len(words)]) if not gone]
        if here:
            out.append(b" ".join(here))
        n += len(words)
    return b" ".join(out).decode(), n


def anchored(texts: DataFrame, window: int) -> DataFrame:
    """``hash``, ``tid``, ``at``: the anchors of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in parts_of(batches, 1):
            found = [anchors(word_hashes(t), window) for t in held]
            tid = np.repeat(part.column(0).to_numpy(), [len(at) for at, _ in found])
            at, hashes = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(tid), pa.array(at.astype(np.int32))], names=["hash", "tid", "at"])

    return texts.select("tid", "text").mapInArrow(run, "hash long, tid long, at int")


def windows(texts: DataFrame, window: int) -> DataFrame:
    """``first``, ``second`` (128 bits that stand for a window's words), ``tid``, ``at``: all windows that hold one of the text's anchors ``places``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in parts_of(batches, 1):
            for tid, text, places in zip(part.column(0).to_pylist(), held, part.column(2)):
                words = word_hashes(text)
                at = extended(places.values.to_numpy(), len(words), window)
                both = [window_hashes(w, window)[at].view(np.int64) for w in (words, words ^ _SECOND)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, both), pa.array(np.full(len(at), tid)), pa.array(at.astype(np.int32))], names=["first", "second", "tid", "at"])

    return texts.select("tid", "text", "places").mapInArrow(run, "first long, second long, tid long, at int")


def recurring(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """``tid`` and its places (``name``) whose key another row has, too. Only counts of keys are shuffled for all; rows of frequent keys are not."""
    n = save(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
    found = save(looked_up(rows, n, key, rows.count()).groupBy("tid").agg(F.collect_list("at").alias(name)))
    discard(n)
    return found


def shortened(texts: DataFrame, window: int) -> DataFrame:
    """Adds ``kept``, ``n_words`` and ``n_removed``: ``starts`` has the recurring windows, and ``n`` how many rows have the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in parts_of(batches, 3):
            out, counts, gone = [], [], []
            for text, n, starts in zip(held, part.column(2).to_pylist(), part.column(4)):
                kept, n_words = kept_words(text, None)
                removed = 0
                if n > 1 and n_words >= window:
                    kept, removed = "", n_words
                elif starts.is_valid:
                    mask = covered(starts.values.to_numpy(), n_words, window)
                    kept, removed = kept_words(text, mask)[0], int(mask.sum())
                out.append(kept)
                counts.append(n_words)
                gone.append(removed)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=["c1", "c2", "n", "kept", "n_words", "n_removed"])

    return texts.select("c1", "c2", "n", "text", "starts").mapInArrow(run, "c1 long, c2 long, n long, kept string, n_words long, n_removed long")


def without_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", returned: dict[str, Column] | None = None) -> DataFrame:
    """Every row's ``doc_id``, ``text`` without the repeated passages, ``n_words`` and ``n_removed``.

    A window is ``window`` consecutive words of a row. Every word is removed that is covered by a window whose words also
    start anywhere else, in the same text or another; what is left is joined by one space. Windows are judged on the input. Instead of
    ``text``, ``returned`` may name other columns that are made of ``kept`` (such as its digest), so that texts needn't be shuffled.

    Each distinct text is kept once, with the number of its rows: where there are several, and as many words as a window has, nothing is left.
    Windows of some fifteen words are hashed at the places of a difference cover modulo 21. Any two equal windows of 35 words have
    an equal anchor at the same distance from their start; anchors that recur are extended to all whole windows that hold
    them, and those that recur, by 128 bits, are removed. Keys are counted before rows meet, and rows of frequent keys aren't shuffled.
    Texts are divided into words a megabyte at a time.

    Null and empty texts have no words and come out empty. Repeated rows come out as often; rows with a null id are judged
    like any other. Other columns are left.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns({"c1": F.xxhash64("text"), "c2": F.xxhash64(F.lit(1), "text")})
    rows = save(named.select("doc_id", "c1", "c2"))
    texts = save(named.groupBy("c1", "c2").agg(F.first("text").alias("text"), F.count("*").alias("n")).withColumn("tid", F.monotonically_increasing_id()))
    # each step is saved before the next shuffles the texts, so that what one shuffles is gone by then
    found = save(anchored(texts, window))
    places = recurring(found, ["hash"], "places")
    discard(found)
    wide = save(windows(texts.join(places, "tid"), window))
    starts = recurring(wide, ["first", "second"], "starts")
    discard(wide, places)
    of_text = shortened(texts.join(starts, "tid", "left"), window)
    of_text = save(of_text.select("c1", "c2", "n", *[c.alias(k) for k, c in (returned or {"text": F.col("kept")}).items()], "n_words", "n_removed"))
    discard(texts, starts)
    # a frequent text, whose row is broadcast, keeps fewer words than a window has
    return looked_up(rows, of_text, ["c1", "c2"], rows.count()).drop("c1", "c2")
