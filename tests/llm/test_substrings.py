import hashlib
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketeer.llm import substrings
from docketeer.llm.substrings import COVERS

DOCS = "doc_id long, text string"


def brute(texts, window):
    """Kept text, number of words and of removed words of each text, by a dictionary of all windows."""
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out


def prose(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('abcdefgh')}{r.randrange(30)}" for _ in range(n)]


@pytest.mark.parametrize("period", COVERS)
def test_covers_align_any_two_places(period):
    places = COVERS[period]
    for i, j in product(range(period), repeat=2):
        assert any((i + d) % period in places and (j + d) % period in places for d in range(period)), (i, j)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 15, 29, 35, 64])
def test_window_hashes_depend_on_the_words_and_their_order_alone(width):
    r = np.random.default_rng(1)
    words = r.integers(0, 3, 400).astype(np.uint64) * np.uint64(0x123456789ABCDEF)
    hashes = substrings.window_hashes(words, width)
    assert len(hashes) == 400 - width + 1
    for a, b in r.integers(0, len(hashes), (3000, 2)):
        assert (hashes[a] == hashes[b]) == (words[a : a + width] == words[b : b + width]).all()


@pytest.mark.parametrize("window", [2, 6, 12, 35])
def test_passages_against_all_windows(spark, window):
    r = random.Random(window)
    shared = [prose(900 + i, r.randrange(window - 1, 4 * window)) for i in range(6)]
    texts = []
    for i in range(60):
        w = prose(i, r.randrange(0, 120))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(shared)
        texts.append(r.choice([" ", "\n", "\t ", "\x0b"]).join(w))
    texts += [texts[3], texts[3], " ".join(prose(77, window)), " ".join(prose(77, window - 1)), " ".join(prose(77, window - 1)), " ".join(["same"] * (3 * window))]
    got = sorted((row.doc_id, row.text, row.n_words, row.n_removed) for row in substrings.without_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS), window).collect())
    assert got == [(i, *b) for i, b in enumerate(brute(texts, window))]
    assert any(0 < n < w for _, _, w, n in got)


def test_odd_rows_of_passages(spark):
    passage = " ".join(prose(5, 40))
    long = " ".join(prose(6, 30_000)) + " " + "x" * 1_500_000 + " " + passage
    rows = [(1, None), (2, ""), (3, " \n"), (4, passage), (4, passage), (None, passage + " end"), (None, None), (5, "one\x1fword \x85 é"), (6, long), (6, "other")]
    docs = spark.createDataFrame([(*r, "a", 7, 1) for r in rows], DOCS + ", kept string, tid int, n int")
    got = substrings.without_repeats(docs)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed"]
    wanted = Counter((d, *b) for (d, _), b in zip(rows, brute([t for _, t in rows], 35)))
    assert Counter(tuple(r) for r in got.collect()) == wanted
    assert substrings.without_repeats(docs.limit(0)).count() == 0
    digest = {"kept_sha256": F.sha2(F.col("kept").cast("binary"), 256)}
    digests = {r.kept_sha256 for r in substrings.without_repeats(docs.where("doc_id = 6"), returned=digest).collect()}
    assert digests == {hashlib.sha256(t.encode()).hexdigest() for t in (long, "other")}


def test_a_frequent_passage_is_counted_before_rows_meet(spark):
    passage = " ".join(prose(8, 60))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " "), F.col("id").cast("string")).alias("text"))
    assert {(r.n_words, r.n_removed) for r in substrings.without_repeats(docs).collect()} == {(61, 60)}
