"""Where a corrected text differs from the one before it, as places in the corrected text."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column

from docketeer.functions.batches import by_parts

#: Parts are compared by lines, then by words, then letter by letter; letter by letter only up to this many on either side.
LEVELS = (re.compile(r"[^\n]*\n|[^\n]+"), re.compile(r"\s+|[^\s]+"))
MOST_LETTERS = 400
PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of elements that both have once, as many as keep their order: the longest increasing sequence."""
    once = lambda xs: {x for x, n in Counter(xs).items() if n == 1}
    common = once(a) & once(b)
    at = {x: j for j, x in enumerate(b) if x in common}
    pairs = [(i, at[x]) for i, x in enumerate(a) if x in common]
    ends: list[int] = []  # the least last place of an increasing sequence of each length, and where it is in pairs
    rows: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before[k] = rows[n - 1] if n else -1
        ends[n:], rows[n:] = [j, *ends[n + 1 :]], [k, *rows[n + 1 :]]
    out, k = [], rows[-1] if rows else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def spans(a: str, b: str, at: int = 0, level: int = 0) -> Iterator[tuple[int, int]]:
    """The spans of ``b`` (moved by ``at``) whose content ``a`` doesn't have there; where something is only missing, an empty one.

    What both begin and end with is the same. In between, lines that both have once divide the texts, then such words, and what
    is left between two of these is compared letter by letter. So time and memory grow with the texts, not with their product.
    """
    low = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b, at = a[low:], b[low:], at + low
    same = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a or not b:
        if a or b:
            yield at, at + len(b)
        return
    if (k := b.find(a)) >= 0:  # something was added on both sides
        yield from ((at, at + k), (at + k + len(a), at + len(b)))
        return
    if len(a) <= MOST_LETTERS and len(b) <= MOST_LETTERS:
        for kind, _, _, j, k in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if kind != "equal":
                yield at + j, at + k
        return
    if level == len(LEVELS):
        yield at, at + len(b)
        return
    parts_a, parts_b = LEVELS[level].findall(a), LEVELS[level].findall(b)
    common = anchors(parts_a, parts_b)
    if not common and max(len(parts_a), len(parts_b)) <= MOST_LETTERS:
        common = [(k + n, m + n) for k, m, size in difflib.SequenceMatcher(None, parts_a, parts_b, autojunk=False).get_matching_blocks() for n in range(size)]
    i = j = y = 0  # parts done of both, and the letters of the second
    for k, m in [*common, (len(parts_a), len(parts_b))]:
        old, new = "".join(parts_a[i:k]), "".join(parts_b[j:m])
        yield from spans(old, new, at + y, level + 1)
        y += len(new) + (len(parts_b[m]) if m < len(parts_b) else 0)
        i, j = k + 1, m + 1


def joined(found: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in found:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def changed_places(before: Column, after: Column) -> Column:
    """The spans of each text's correction that differ."""
    return by_parts(lambda a, b: joined(spans(a or "", b or "")), "array<struct<start int, end int>>", PLACES)(before, after)
