"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketeer.llm.common import kept_by_worker, parts_of, save

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


#: Texts of these characters are lower-cased and divided here, as the tokenizer would: it changes nothing else about them.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def divided(text: str) -> list[str | bytes]:
    """The text's words; what stands between white space and isn't plain is one unit, as bytes."""
    if PLAIN.fullmatch(text) and "<|" not in text:
        return WORDS.findall(text.lower())
    out: list[str | bytes] = []
    for unit in text.encode().split():
        own = unit.decode()
        if PLAIN.fullmatch(own) and "<|" not in own:
            out += WORDS.findall(own.lower())
        else:
            out.append(unit)
    return out


class WordIds(dict):
    """Token ids, as little-endian bytes, of words and of units that aren't plain.

    The tokenizer drops white space and merges only within a word, so a text's ids are its words' ids in order. Up to ``most``
    words are remembered.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.most, self.whole, self.bare = most, Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.now: dict[str | bytes, bytes] = {}  # what this batch needs besides what is remembered

    def __missing__(self, word: str | bytes) -> bytes:
        return self.now[word]

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        parts = [divided(t) for t in texts]
        new = set().union(*parts).difference(self)
        words, units = [w for w in new if isinstance(w, str)], [u for u in new if isinstance(u, bytes)]
        self.now = {}
        if words:
            x = self.bare.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(x.ids, "<u4").tobytes()
            ends = [0, *(4 * (np.flatnonzero(np.diff(x.word_ids)) + 1)).tolist(), len(ids)]
            self.now = {word: ids[a:b] for word, (a, b) in zip(words, pairwise(ends), strict=True)}
        for unit, x in zip(units, self.whole.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)):
            self.now[unit] = np.array(x.ids, "<u4").tobytes()
        self.update(islice(self.now.items(), max(0, self.most - len(self))))
        return [b"".join(map(self.__getitem__, own)) for own in parts]


def cut(ids: bytes, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of at most ``most`` tokens: number, start, length, CRC-32."""
    width = 4 * most
    for piece, start in enumerate(range(0, len(ids), width)):
        part = ids[start : start + width]
        yield piece, start // 4, len(part) // 4, zlib.crc32(part)


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document's token ids, which end with ``end_id``.

    A null or empty text has that one id. Documents longer than ``most`` are cut; repeated rows give repeated pieces.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_by_worker("packing", tokenizer, lambda: WordIds(tokenizer))
        for part, texts in parts_of(batches, 1):
            at, rows = [], []
            for i, own in enumerate(words.of([text or "" for text in texts])):
                for row in cut(own + end, most):
                    at.append(i)
                    rows.append(row)
            piece, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


class OpenBins:
    """A fixed number of open bins; a bitset holds the free spaces at which there is one."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset of the next item: the open bin with the least space that holds it, or else a new one."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self.take(free)
        else:
            if self.open == self.most:
                self.take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.size, self.made
            self.made += 1
        left = free - length
        if left:  # a full bin closes
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.size - free

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pack(pieces: DataFrame, size: int = 4096, open_bins: int = 256, tokens_a_task: int = 1 << 25) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces, whose ``length`` is between 1 and ``size``.

    Each task packs about ``tokens_a_task`` tokens as they arrive, in an order that says nothing of their lengths, and has at
    most ``open_bins`` open bins. The order is fixed by a hash of the id, and by piece, so a task that runs again gives the same bins;
    pieces without an id are dealt out by their place in the input. No pieces: no rows.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // tokens_a_task))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [bins.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array([first + n for n, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    turn = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()))
    dealt = pieces.withColumn("turn", turn).repartition(int(tasks), "turn", "piece", "start")
    return dealt.sortWithinPartitions("turn", "doc_id", "piece", "ids_crc32").mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, **columns: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most ``size`` tokens."""
    return pack(save(token_pieces(docs, tokenizer, size, **columns)), size)
