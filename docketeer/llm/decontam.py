"""Benchmark passages in documents: exact pieces by an Aho-Corasick automaton, then edit distance by Myers' bit vectors."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketeer.llm.common import kept_by_worker, parts_of, save

WORD = re.compile(r"[^\W_]+")
MATCHES = "doc_id long, item_id long, distance int, start long, end long"


def plain(text: str) -> str:
    """Lower-case words of letters and digits with single spaces between them."""
    return " ".join(WORD.findall(text)).lower()


class Places:
    """Where ranges of the plain text lie in the text itself, by whole words."""

    def __init__(self, text: str) -> None:
        self.words = [m.span() for m in WORD.finditer(text)]
        self.starts, at = [], 0
        for a, b in self.words:
            self.starts.append(at)
            at += len(text[a:b].lower()) + 1

    def of(self, start: int, end: int) -> tuple[int, int]:
        word = lambda i: self.words[max(0, bisect_right(self.starts, i) - 1)]
        return word(start)[0], word(max(start, end - 1))[1]


def bounded(text: str) -> str:
    """A plain text with a space before and behind it, as between its words: an item's spaces match where words begin and end."""
    return f" {text} "


def masks(pattern: str) -> dict[str, int]:
    """For each character the places at which the pattern has it, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(peq: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """Least distance of the pattern to a part of the text, and that part's first possible end; None beyond the budget."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full  # the match may begin anywhere, so no cost enters above
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = score, j + 1
    return best


@dataclass
class Part:
    """Some consecutive pieces of an item: fewer errors than pieces must be in it, or it's another part that matches."""

    start: int
    end: int
    budget: int
    peq: dict[str, int]


@dataclass
class Item:
    number: int
    text: str
    pieces: list[tuple[int, int]]
    above: list[list[Part]]  # for each piece, the larger and larger parts that hold it; the last is the whole
    whole: dict[str, int]
    reverse: dict[str, int]

    @classmethod
    def of(cls, number: int, plain_text: str, rate: float) -> Item:
        text = bounded(plain_text)
        n = int(len(plain_text) * rate) + 1  # pieces: one more than the errors allowed
        edges = [len(text) * i // n for i in range(n + 1)]
        above: list[list[Part]] = [[] for _ in range(n)]

        def divide(a: int, b: int, over: list[Part]) -> None:
            part = Part(edges[a], edges[b], b - a - 1, masks(text[edges[a] : edges[b]]))
            if b - a == 1:
                above[a] = over[::-1] or [part]
                return
            middle = (a + b) // 2
            divide(a, middle, [*over, part])
            divide(middle, b, [*over, part])

        divide(0, n, [])
        return cls(number, text, list(zip(edges, edges[1:])), above, masks(text), masks(text[::-1]))

    def around(self, piece: int, at: int) -> tuple[int, int]:
        """What a match that has an exact hit of a piece there can reach."""
        budget, begin = len(self.pieces) - 1, at - self.pieces[piece][0]
        return max(0, begin - budget), begin + len(self.text) + budget

    def may_match(self, text: str, piece: int, at: int) -> bool:
        """Whether every larger part around an exact hit of a piece allows a match."""
        begin = at - self.pieces[piece][0]
        return all(myers(p.peq, p.end - p.start, text[max(0, begin + p.start - p.budget) : begin + p.end + p.budget], p.budget) for p in self.above[piece])

    def closest(self, text: str, windows: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        """Distance, start and end of the closest match within the windows, the leftmost end of equals."""
        best = None
        for low, high in windows:
            window = text[low:high]
            found = myers(self.whole, len(self.text), window, len(self.pieces) - 1)
            if found and (best is None or found[0] < best[0]):
                distance, end = found
                start = myers(self.reverse, len(self.text), window[:end][::-1], distance)
                best = distance, low + end - start[1], low + end
        return best


class Matcher:
    """All pieces of the items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [Item.of(i, t, rate) for i, text in items if (t := plain(text or ""))]
        held: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            for k, (a, b) in enumerate(item.pieces):
                held.setdefault(item.text[a:b], []).append((i, k))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in held.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if held:
            self.automaton.make_automaton()

    def find(self, plain_text: str) -> dict[int, tuple[int, int, int]]:
        """For each item found in the text its closest match, the leftmost of equals: distance, start, end in the plain text.

        Each exact hit of a piece whose larger parts allow a match opens a window, and hits within an open window widen it.
        Every match lies whole in the window of a hit, so the least distance in the windows is the least there is.
        """
        if not self.items:
            return {}
        text = bounded(plain_text)
        windows: dict[int, list[list[int]]] = {}
        for last, (size, owners) in self.automaton.iter(text):
            at = last + 1 - size
            for item, piece in owners:
                low, high = self.items[item].around(piece, at)
                held = windows.get(item)
                if held and held[-1][0] <= at < held[-1][1]:
                    held[-1][0], held[-1][1] = min(low, held[-1][0]), max(high, held[-1][1])
                elif self.items[item].may_match(text, piece, at):
                    windows.setdefault(item, []).append([low, high])
        found: dict[int, tuple[int, int, int]] = {}
        for i, held in windows.items():
            item = self.items[i]
            match = item.closest(text, held)
            if match:
                distance, start, end = match
                own = text[start:end]
                match = distance, start + len(own) - len(own.lstrip()) - 1, end - (len(own) - len(own.rstrip())) - 1
                found[item.number] = min(match, found.get(item.number, match))
        return found

    def has_any(self, plain_text: str) -> bool:
        """Whether a match of any item is in the text."""
        text = bounded(plain_text)
        return bool(self.items) and any(self.items[item].may_match(text, piece, last + 1 - size) for last, (size, owners) in self.automaton.iter(text) for item, piece in owners)


@contextmanager
def shared(items: DataFrame, number: int, n: int) -> Iterator[Broadcast]:
    """One of ``n`` blocks of the items, broadcast for as long as it is needed."""
    own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == number)
    held = items.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()])
    try:
        yield held
    finally:
        if n > 1:
            held.destroy()


def prepared(items: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """The items with a text, and in how many blocks of about ``block_chars`` characters they go out."""
    items = items.select(F.col("item_id").cast("long"), F.col("text")).where("text IS NOT NULL")
    return items, max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))


def matcher(held: Broadcast, rate: float) -> Matcher:
    """A worker's automaton of the block, which it keeps from task to task."""
    return kept_by_worker("decontam", (rate, tuple(held.value)), lambda: Matcher(held.value, rate))


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """A row for each document and test item that it holds: the closest match's distance and place (code points).

    A match differs from the item in at most ``rate`` of its characters (insertions, deletions, replacements), both without
    case and punctuation. It begins and ends where words do: a letter before or behind it counts as an error, so an item that
    is too short for any error matches whole words only. Null texts and items without a letter or digit match nothing; of items that share an
    id the closest counts; repeated documents repeat their rows. ``docs``: doc_id, text. ``items``: item_id, text. Other columns are left.
    Items go out in blocks of about ``block_chars`` characters, one after the other: with several, each block's matches are
    saved, and its broadcast is removed before the next.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    items, n = prepared(items, block_chars)
    found = []
    for i in range(n):
        with shared(items, i, n) as held:
            own = docs.mapInArrow(matching(held, rate), MATCHES)
            found.append(save(own) if n > 1 else own)
    return reduce(DataFrame.union, found)


def matching(held: Broadcast, rate: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(held, rate)
        for part, texts in parts_of(batches, 1):
            ids, rows = part.column(0), []
            for i, text in enumerate(texts):
                if found := own.find(plain(text or "")):
                    at = Places(text)
                    rows += [(ids[i].as_py(), item, distance, *at.of(start, end)) for item, (distance, start, end) in found.items()]
            if rows:
                columns = zip(*rows)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "distance", "start", "end"])

    return run


def without_matches(docs: DataFrame, items: DataFrame, rate: float = 0.08, block_chars: int = 4_000_000, text_col: str = "text") -> DataFrame:
    """The rows whose text holds no test item, with all their columns; rows with a null text stay.

    With several blocks of items each leaves a saved table for the next, and its broadcast is removed.
    """
    at = docs.columns.index(text_col)
    items, n = prepared(items, block_chars)
    for i in range(n):
        with shared(items, i, n) as held:

            def run(batches: Iterable[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
                own = matcher(held, rate)
                for part, texts in parts_of(batches, at):
                    yield part.filter(pa.array([not own.has_any(plain(t or "")) for t in texts], pa.bool_()))

            docs = docs.mapInArrow(run, docs.schema)
            docs = save(docs) if n > 1 else docs
    return docs
