import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docketeer.llm import queries, spelling


def brute(counts, least=5, letters=6, factor=5):
    """Form, root, n, number of near words and the form's n of each word, by all deletions in a dictionary of strings."""
    held = {w: n for w, n in counts.items() if n >= least and len(w) >= letters}
    near, left = defaultdict(set), defaultdict(list)
    for w in held:
        for i in range(len(w)):
            x = w[:i] + w[i + 1 :]
            left[x, i].append(w)
            if x in held:
                near[w].add(x)
                near[x].add(w)
    for group in left.values():
        for w in group:
            near[w] |= set(group) - {w}
    form = {}
    for w in held:
        if near[w]:
            best = min(near[w], key=lambda x: (-held[x], x))
            if held[best] >= factor * held[w]:
                form[w] = best
    out = {}
    for w in held:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, held[w], len(near[w]), held[form[w]] if w in form else None)
    return out


def found(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def words_of(spark, counts):
    rows = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, times int, form string")
    return rows.select("word", "form", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("n"))


def test_variants_against_all_deletions(spark):
    r = random.Random(2)
    counts = {}
    for _ in range(1200):
        w = "".join(r.choice("abé") for _ in range(r.randrange(5, 9)))
        counts[w] = r.choice([1, 4, 5, 6, 25, 30, 130, 700])
    got = found(spelling.variants(words_of(spark, counts)))
    assert got == brute(counts)
    assert any(root not in (w, form) for w, (form, root, *_) in got.items())


def test_swapped_letters_are_not_near_and_ties_go_by_code_points(spark):
    counts = {"judgment": 100, "jugdment": 5, "judgement": 500, "judgmenz": 5, "judgmens": 100, "aaaaaaa": 50, "aaaaaa": 5, "ébcdefg": 50, "zbcdefg": 50, "bcdefg": 5}
    got = found(spelling.variants(words_of(spark, counts)))
    assert got == brute(counts)
    assert got["jugdment"][3] == 0 and got["judgment"][:2] == ("judgement", "judgement") and got["judgmenz"][0] == "judgmens" and got["bcdefg"][0] == "zbcdefg"


def test_odd_words(spark):
    long = "".join(random.Random(3).choice("abcdefghij") for _ in range(3000))
    counts = {long: 5, long[:900] + long[901:]: 25, "short": 900, "": 9, "école": 5, "ecolés": 30}
    rows = words_of(spark, counts).unionByName(spark.createDataFrame([(None, "x", 1)] * 9, "word string, form string, n int"))
    assert found(spelling.variants(rows)) == brute(counts)
    assert spelling.variants(rows.limit(0)).count() == 0


def test_keys_of_deletions_are_hashes_of_what_is_left():
    words = ["judgment", "ab", "a", "ééa", "x" * 40]
    keys, number, at, apart = spelling.deletion_keys(words)
    of = defaultdict(set)
    for k, i, p in zip(keys.tolist(), number.tolist(), at.tolist()):
        of[words[i] if p < 0 else words[i][:p] + words[i][p + 1 :]].add(k)
    assert all(len(v) == 1 for v in of.values()) and len({next(iter(v)) for v in of.values()}) == len(of)
    assert [w[p] for w, i, p, a in ((words[i], i, p, a) for i, p, a in zip(number, at, apart)) if p >= 0 and a and w == "ééa"] == ["é", "a"]


def test_runs_of_letters_and_the_drawn_deletions(spark):
    r = random.Random(4)
    base = ["appellant", "Respondent", "ÉCOLES", "plaintiff", "école×s", "under", "ordered"]
    texts = [(i, " ".join(r.choice(base) + r.choice(["", ",", "1", "-"]) for _ in range(400))) for i in range(60)] + [(None, "appellant " * 9), (61, None), (62, ""), (7, texts_again(base))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("clash"))
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for d, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    assert Counter(r.word for r in spelling.occurrences(docs).collect()) == Counter(w.translate(lower) for _, t in texts for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    assert found(spelling.variants(queries.drawn_words(docs))) == brute(counts)


def texts_again(base):
    return " ".join(base) * 30


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_rows_with_shared_keys_over_batches(spark, size):
    r = random.Random(size)
    keys = [r.randrange(60) for _ in range(100)]
    rows = spark.createDataFrame([(k, i, 0, True) for i, k in enumerate(keys)], "key long, number long, at int, apart boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = sorted(r.number for r in spelling.shared_keys(rows).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [i for i, k in enumerate(keys) if keys.count(k) > 1]
