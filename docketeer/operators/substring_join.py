"""Which terms occur in which texts: a rare q-gram of each term is looked for in the texts, and what stands around it meets the terms."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketeer.functions.batches import by_parts
from docketeer.sources.shared import kept

Q = 4
MOST_BYTES = 64_000_000  # of keys that are broadcast; more are dealt with the texts' grams
MOST_SHAPES = 200_000  # that each task looks for in its texts; with more, all grams of the texts are dealt; as many terms at most are known to it
TABLE_BITS = 20


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` code points. A regular expression finds them in one pass; ``substring`` would count from the start each time."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def chosen_keys(terms: DataFrame, texts: DataFrame, q: int, sample: int) -> DataFrame:
    """``term`` and its ``key``: that of its grams which fewest of ``sample`` texts have; a term of fewer letters is its own key.

    Any gram would give the same pairs; a rare one gives few that must be compared.
    """
    some = texts.orderBy(F.xxhash64("text")).limit(sample)
    seen = some.select(F.explode(grams(F.col("text"), q)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    long = terms.where(F.length("term") > q).select("term", F.explode(grams(F.col("term"), q)).alias("key"))
    ranked = long.join(seen, "key", "left").withColumn("rn", F.row_number().over(Window.partitionBy("term").orderBy(F.coalesce("n", F.lit(0)), "key")))
    return ranked.where("rn = 1").select("term", "key").unionByName(terms.where(F.length("term") <= q).select("term", F.col("term").alias("key")))


def hashed(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` code points; equal runs have equal ones."""
    out = np.zeros(max(len(codes) - size + 1, 0), np.uint64)
    for i in range(size):
        out = (out + codes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def around(shapes: list[tuple[str, int, int]], terms: frozenset[str] | None = None) -> Callable[[str | None], list[str]]:
    """A function of a text: the distinct runs of it that have one of the shapes, of the ``terms`` only if these are given.

    A shape is a key, its place in the run, and the run's length.
    """
    codes = lambda text: np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    slots = lambda numbers: (numbers >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    by_size: dict[int, dict[int, set[tuple[int, int]]]] = {}
    for key, offset, size in shapes:
        by_size.setdefault(len(key), {}).setdefault(int(hashed(codes(key), len(key))[0]), set()).add((offset, size))
    tables = []
    for length, own in by_size.items():
        table = np.zeros(1 << TABLE_BITS, bool)
        table[slots(np.array(list(own), np.uint64))] = True
        tables.append((length, table, own))

    def found(text: str | None) -> list[str]:
        out: set[str] = set()
        if text:
            letters, n = codes(text), len(text)
            for length, table, own in tables:
                numbers = hashed(letters, length)
                places = np.flatnonzero(table[slots(numbers)])
                for at, number in zip(places.tolist(), numbers[places].tolist()):
                    out.update(text[at - o : at - o + size] for o, size in own.get(number, ()) if o <= at and at - o + size <= n)
        return list(out if terms is None else out & terms)

    return found


def contained(texts: DataFrame, terms: DataFrame, q: int = Q, sample: int = 2000, most_shapes: int = MOST_SHAPES) -> DataFrame:
    """``id`` and ``term``: the distinct terms that each text contains. ``texts``: id, text; ``terms``: term.

    A text that contains a term contains its key, with the term around it. So the runs that have a term's length and lie around a key as in the term
    are all that may be a term, and those that equal one are. No pair is made of a text and a term that only share a key, the texts are read once and not
    shuffled. Empty and null terms are in no text; null texts contain nothing. Texts with the same id, or without one, count as one text each: they
    are told apart by their digest.
    """
    texts = texts.where(F.col("text").isNotNull()).select("id", "text", F.xxhash64("text").alias("__h"))
    terms = terms.where(F.length("term") > 0).select("term").distinct()
    keys = kept(chosen_keys(terms, texts, q, sample))
    bytes_ = keys.agg(F.sum(F.octet_length("term") + F.octet_length("key") + 64)).first()[0]
    if not bytes_:
        return texts.select("id", F.lit("").alias("term")).where(F.lit(False))
    known = F.broadcast(keys) if bytes_ <= MOST_BYTES else keys
    shapes = keys.select("key", (F.instr("term", F.col("key")) - 1).alias("offset"), F.length("term").alias("size")).distinct().limit(most_shapes + 1).collect()
    if len(shapes) > most_shapes:
        return contained_by_grams(texts, keys, known)
    few = [r.term for r in keys.select("term").limit(most_shapes + 1).collect()]
    runs = by_parts(around([tuple(r) for r in shapes], frozenset(few) if len(few) <= most_shapes else None), "array<string>", pa.list_(pa.string()))
    met = texts.select("id", "__h", F.explode(runs(F.col("text"))).alias("term")).join(known.select("term"), "term")
    return met.dropDuplicates(["id", "__h", "term"]).select("id", "term")


def contained_by_grams(texts: DataFrame, keys: DataFrame, known: DataFrame) -> DataFrame:
    """The same for more shapes than a task can look for: the grams of a text, dealt without the text, meet the keys, and the pairs with a key in common are compared."""
    sizes = keys.agg(F.collect_set(F.length("key"))).first()[0]
    own = texts.select("id", "__h", F.explode(F.array_distinct(F.concat(*[grams(F.col("text"), n) for n in sorted(sizes)]))).alias("key"))
    candidates = own.join(known, "key").select(F.col("id").alias("__id"), F.col("__h").alias("__hash"), "term")
    met = candidates.join(texts.dropDuplicates(["id", "__h"]), F.col("__id").eqNullSafe(F.col("id")) & (F.col("__hash") == F.col("__h")))
    return met.where(F.contains(F.col("text"), F.col("term"))).dropDuplicates(["id", "__h", "term"]).select("id", "term")
