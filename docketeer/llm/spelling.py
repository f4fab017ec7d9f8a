"""Spelling variants: words at one edit from one another, found by hashes of what is left when a letter is deleted."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketeer.llm.common import discard, gathered, parts_of, save

LETTERS = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_MIX, _LENGTH = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def lowered(word: Column) -> Column:
    """A to Z in lower case; other letters as they are."""
    return F.when(word.rlike("[À-Þ]"), F.translate(word, _UPPER, _LOWER)).otherwise(F.lower(word))


def without(word: Column, at: Column) -> Column:
    """A word without the code point at a place, counted from 0."""
    return F.concat(F.left(word, at), F.substr(word, at + 2))


def occurrences(docs: DataFrame, least_letters: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``word``: every run of letters of the whole texts, with A to Z in lower case. Null texts have none."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.col(id_col).alias("doc_id"), run.alias("run")).where(F.length("run") >= least_letters)
    return runs.select("doc_id", lowered(F.col("run")).alias("word"))


def mixed(hashes: np.ndarray) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _LENGTH
    return x ^ (x >> np.uint64(32))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, number of the word, deleted place, and whether the letter before it differs, for each place of each word; place -1 is the whole word.

    A word's hash is the polynomial of its letters. What a deletion leaves has the polynomial of the prefix, plus that of the suffix
    moved down by one power, so all keys come from one running sum.
    """
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(length) - length
    number = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(letters)) - start[number]
    powers = np.full(int(length.max(initial=0)) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = mixed(letters.astype(np.uint64) + _LENGTH) * powers[at]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    whole = sums[start + length] - sums[start]
    before = sums[:-1] - sums[start][number]
    left = before + (whole[number] - before - terms) * _INVERSE
    apart = (at == 0) | (letters != np.concatenate([letters[:1], letters[:-1]]))
    keys = np.concatenate([mixed(left + (length[number] - 1).astype(np.uint64) * _LENGTH), mixed(whole + length.astype(np.uint64) * _LENGTH)])
    return keys, np.concatenate([number, np.arange(len(words))]), np.concatenate([at, np.full(len(words), -1)]), np.concatenate([apart, np.ones(len(words), bool)])


def keyed(words: DataFrame) -> DataFrame:
    """``key``, ``number``, ``at``, ``apart``: the deletion keys of each word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in parts_of(batches, 1, 1 << 17):
            keys, which, at, apart = deletion_keys(held)
            numbers = part.column(0).to_numpy()[which]
            for k in range(0, len(keys), 1 << 16):
                s = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[s].view(np.int64)), pa.array(numbers[s]), pa.array(at[s].astype(np.int32)), pa.array(apart[s])], names=["key", "number", "at", "apart"])

    return words.select("number", "word").mapInArrow(run, "key long, number long, at int, apart boolean")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows whose key another row has: dealt by the keys' first bits, sorted, and held against their neighbours."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row before this batch, and whether it has an equal one already
        equal = False
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            same = key[1:] == key[:-1]
            first = last is not None and last.column(0)[0].as_py() == key[0]
            kept = np.concatenate([[first], same])
            kept[:-1] |= same
            if last is not None and (first or equal):
                yield last
            equal = bool(kept[-1])
            last = batch.slice(batch.num_rows - 1)
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(kept[:-1]))
        if last is not None and equal:
            yield last

    dealt = keys.repartition(F.shiftrightunsigned("key", 44)).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, number long, at int, apart boolean")


def neighbours(words: DataFrame) -> DataFrame:
    """``number``, ``n_near`` and ``best`` (its ``less``, the negative of its n, and ``word``) of each word that has near words.

    Words of equal length that differ in one letter leave the same when it is deleted from both, at one place only. A word that lacks a letter of
    another is what the other's deletion leaves; of a run of equal letters only the first is deleted for that. Keys are
    collected in groups of words that share what is left, which are held together as strings: an accidental equality of keys joins nothing.
    A group has no more words than the alphabet gives ways to put one letter back.
    """
    rows = shared_keys(keyed(words)).join(words, "number")
    left = F.when(F.col("at") < 0, F.col("word")).otherwise(without(F.col("word"), F.col("at")))
    rows = rows.select("key", "number", "at", "apart", "n", "word", left.alias("left"), F.struct((-F.col("n")).alias("less"), "word").alias("name"))
    place = Window.partitionBy("key", "left", "at")
    ordered = place.orderBy("name")
    alike = Window.partitionBy("key", "left")
    deleted, whole = (F.col("at") >= 0) & F.col("apart"), F.col("at") < 0
    rows = rows.select(
        "number", "name", "at", "apart",
        F.count("*").over(place).alias("here"),
        F.min("name").over(place).alias("top"),
        F.lead("name").over(ordered).alias("next"),
        F.min(F.when(whole, F.col("name"))).over(alike).alias("short"),
        F.min(F.when(deleted, F.col("name"))).over(alike).alias("long"),
        F.count(F.when(deleted, F.lit(1))).over(alike).alias("longer"),
    )
    replaced = F.struct(F.when(whole, 0).otherwise(F.col("here") - 1).alias("n"), F.when(whole, None).when(F.col("top") == F.col("name"), F.col("next")).otherwise(F.col("top")).alias("best"))
    other = F.struct(
        F.when(whole, F.col("longer")).when(deleted & F.col("short").isNotNull(), 1).otherwise(0).alias("n"),
        F.when(whole, F.col("long")).when(deleted, F.col("short")).alias("best"),
    )
    found = rows.select("number", F.explode(F.array(replaced, other)).alias("f")).where("f.n > 0")
    return found.groupBy("number").agg(F.sum("f.n").alias("n_near"), F.min("f.best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words with a form: the last of its form, the form's form and so on.

    Every round takes the root of the root, so the rounds grow with the logarithm of the longest chain; each is saved. A chain's counts
    rise by a factor, so chains are short, and a word is the form of no more words than one edit makes of it.
    """
    n = forms.count()
    roots = save(gathered(forms.select("word", F.col("form").alias("root")), n))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        new = save(gathered(new, n))
        discard(roots)
        roots = new.select("word", "root")
        if new.where("moved").isEmpty():
            return roots


def variants(words: DataFrame, least: int = 5, letters: int = 6, factor: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word with ``letters`` code points that occurs ``least`` times.

    ``words`` has one row (``word``) for each occurrence. Two words are near if one inserted, deleted or replaced code point makes one of the other. A
    word's form is the near word that occurs most often (of several the first by code points), if that is ``factor`` times as often as the word
    itself, or null; its root is where its forms end, or the word itself. Occurrences are counted before they are shuffled.
    Null words count for nothing; empty tables give no rows; other columns are left. A word of any length has as many keys as letters,
    each of a fixed size.
    """
    counts = words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counts = save(counts.withColumn("number", F.monotonically_increasing_id()))
    near = counts.join(neighbours(counts), "number", "left")
    taken = -F.col("best.less") >= factor * F.col("n")
    near = save(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    )
    discard(counts)
    roots = rooted(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
