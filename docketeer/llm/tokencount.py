"""Word-piece counts by a linear-time longest-match automaton that never builds the pieces."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docketeer.llm.common import kept_by_worker, parts_of


#: The public pattern of the byte-level vocabularies, and what it comes to on texts of the PLAIN characters.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")


class LongestMatch:
    """The trie of a vocabulary with failure links and the number of pieces that following each link completes.

    ``continuing`` are the pieces that may follow another within a word; by default the same as the first ones. A word
    that the greedy match can't cover counts as one unknown piece.
    """

    def __init__(self, first: Iterable[bytes], continuing: Iterable[bytes] | None = None) -> None:
        self.go: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.pops = [0]
        self.start = self.inner = 0
        pieces = self._trie(first, 0)
        if continuing is not None:
            self.inner = self._node()
            pieces |= self._trie(continuing, self.inner)
        level = [(c, node, parent) for parent in {self.start, self.inner} for c, node in self.go[parent].items()]
        while level:
            for c, node, parent in level:
                if node in pieces:
                    self.link[node], self.pops[node] = self.inner, 1
                    continue
                at, count = self.link[parent], self.pops[parent]
                while at >= 0 and c not in self.go[at]:
                    at, count = self.link[at], count + self.pops[at]
                if at >= 0:
                    self.link[node], self.pops[node] = self.go[at][c], count
            level = [(c, child, node) for _, node, _ in level for c, child in self.go[node].items()]

    def _node(self) -> int:
        self.go.append({})
        self.link.append(-1)
        self.pops.append(0)
        return len(self.go) - 1

    def _trie(self, pieces: Iterable[bytes], root: int) -> set[int]:
        ends = set()
        for piece in pieces:
            at = root
            for c in piece:
                if c not in self.go[at]:
                    self.go[at][c] = self._node()
                at = self.go[at][c]
            if at != root:
                ends.add(at)
        return ends

    def count(self, word: bytes) -> int:
        """Pieces of a word."""
        go, link, pops = self.go, self.link, self.pops
        at, count = self.start, 0
        for c in word:
            while c not in go[at]:
                count += pops[at]
                at = link[at]
                if at < 0:
                    return 1
            at = go[at][c]
        while at not in (self.start, self.inner):
            count += pops[at]
            at = link[at]
            if at < 0:
                return 1
        return count


def words_of(text: str) -> list[str]:
    return (PLAIN_PATTERN if PLAIN.fullmatch(text) else PATTERN).findall(text)


class Counts(dict):
    """Pieces of each word met; up to ``most`` words are remembered."""

    def __init__(self, automaton: LongestMatch, most: int = 500_000) -> None:
        self.automaton, self.most = automaton, most

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word.encode())
        if len(self) < self.most:
            self[word] = n
        return n


def rank_file(path: str) -> list[bytes]:
    """The pieces of a vocabulary file with a base64 piece and a rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Adds ``n_words`` and ``n_tokens``, the greedy longest-match pieces of the whole text, to every row.

    ``vocabulary`` is a rank file that every executor has. Null and empty texts have none of either. Columns of the input
    with these names are replaced.
    """
    kept = docs.drop("n_words", "n_tokens")
    at = kept.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = kept_by_worker("tokencount", vocabulary, lambda: Counts(LongestMatch(rank_file(vocabulary))))
        for part, texts in parts_of(batches, at):
            n_words, n_tokens = [], []
            for text in texts:
                words = words_of(text or "")
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*part.schema.names, "n_words", "n_tokens"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("n_words", LongType()), StructField("n_tokens", LongType())]))
