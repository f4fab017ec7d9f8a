"""Co-training in plain Python: dictionaries of trigrams, words and metadata values, one document after the other."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docketeer.llm import quality

STEPS = 200


def odds(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def features(text):
    data = (text or "").encode()
    grams = [(data + b"\0\0")[i : i + 3] for i in range(len(data))]
    return grams, data.split()


def ratios(good, bad):
    """How much likelier each feature is in good rows, from counts of both."""
    seen = {f for f in (good | bad) if good[f] + bad[f] > 0}
    total = lambda n: sum(n.values()) + 0.5 * max(1, len(seen))
    return {f: math.log((good[f] + 0.5) / total(good)) - math.log((bad[f] + 0.5) / total(bad)) for f in seen}


def measures(text):
    data, words = (text or "").encode(), (text or "").encode().split()
    size, n = max(1, len(data)), max(1, len(words))
    kind = lambda test: sum(map(test, data)) / size
    upper, digit = kind(lambda c: 65 <= c < 91), kind(lambda c: 48 <= c < 58)
    stops = sum(c in b".!?" for c in data)
    mark = kind(lambda c: 33 <= c < 127 and not chr(c).isalnum() and c not in b".!?")
    other = kind(lambda c: not (c in b"\0\t\n\x0b\x0c\r " or 33 <= c < 127))
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [math.log1p(len(data)), min(size / n, 40), upper, digit, mark, other, stops / n, len(set(words)) / n, again / n]


def fitted(x, y, penalty):
    """Mean, spread and weights of a penalised logistic regression."""
    x, y = np.array(x), np.array(y)
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    ridge, w = np.array([*penalty, 1e-6]), np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = np.array([odds(v) for v in z @ w])
        gradient = z.T @ (y - p) - ridge * w
        w = w + np.clip(np.linalg.solve(z.T @ np.diag(p * (1 - p) + 1e-9) @ z + np.diag(ridge), gradient), -5, 5)
    return mean, spread, w


def line(fit, x):
    mean, spread, w = fit
    return float(np.clip((np.array(x) - mean) / spread, -10, 10) @ w[:-1] + w[-1])


def co_trained(docs, good, check, rounds, confidence):
    """``docs``: id -> (text, values); ``good``: id -> 0 or 1; ``check``: the ids that lines are fitted on. The scores of all documents."""
    base = {c: (Counter(), Counter(), Counter()) for c in (0, 1)}

    def count(into, i, text_class, page_class):
        grams, words = features(docs[i][0])
        if text_class is not None:
            into[text_class][0].update(grams)
            into[text_class][1].update(words)
        if page_class is not None:
            into[page_class][2].update(enumerate(docs[i][1]))

    for i, g in good.items():
        if i not in check:
            count(base, i, g, g)

    def model(counts):
        grams, words, values = (ratios(counts[1][k], counts[0][k]) for k in range(3))

        def inputs(i):
            own, terms = features(docs[i][0])
            means = [sum(grams.get(g, 0.0) for g in own) / max(1, len(own)), sum(words.get(w, 0.0) for w in terms) / max(1, len(terms))]
            return means + measures(docs[i][0]), [sum(values.get(v, 0.0) for v in enumerate(docs[i][1]))]

        held = sorted(check)
        x = [inputs(i) for i in held]
        y = [float(good[i]) for i in held]
        text, page = fitted([a for a, _ in x], y, [0.1] * 2 + [10.0] * 9), fitted([b for _, b in x], y, [0.1])
        return {i: (line(text, a), line(page, b)) for i, (a, b) in ((i, inputs(i)) for i in docs)}

    scores, limit = model(base), math.log(confidence / (1 - confidence))
    sure = lambda v: None if abs(v) < limit else int(v > 0)
    for _ in range(rounds):
        counts = {c: tuple(Counter(x) for x in base[c]) for c in (0, 1)}
        for i in docs.keys() - good.keys():
            count(counts, i, sure(scores[i][1]), sure(scores[i][0]))
        scores = model(counts)
    share = (sum(good.values()) + 1) / (len(good) + 2)
    return {i: (odds(t), odds(p), odds(t + p - math.log(share / (1 - share)))) for i, (t, p) in scores.items()}


def test_scores_against_plain_python(spark):
    r = random.Random(21)
    vocabulary = ["law", "act.", "Sum!", "a1", "99", "é"]

    def text(i):
        if i % 17 == 0:
            return r.choice([None, "", "  \n"])
        some = vocabulary if i % 2 else vocabulary[3:] + ["zz", "#$"]
        return " ".join(r.choice(some) for _ in range(r.randrange(1, 30)))

    docs = {i: (text(i), [r.choice(["web", "mail", None] if i % 2 else ["web", "junk", "mail"]), r.choice(["en", None])]) for i in range(360)}
    good = {i: int(i % 2 == 1) if r.random() < 0.9 else i % 3 // 2 for i in range(0, 360, 2) if r.random() < 0.5} | {i: 1 for i in range(1, 360, 6)}
    # the features that meet in one bucket of the operator would have one weight, which plain Python doesn't do
    grams = {g for t, _ in docs.values() for g in features(t)[0]}
    words = {w for t, _ in docs.values() for w in features(t)[1]}
    bucket = lambda parts, of: len({of(quality.Texts([p.decode("latin-1")])) for p in parts}) == len(parts)
    ascii_grams, ascii_words = [g for g in grams if max(g) < 128 and b"\0" not in g], [w for w in words if max(w) < 128]
    assert bucket(ascii_grams, lambda t: int(t.grams[0])) and bucket(ascii_words, lambda t: int(t.buckets[0]))

    frame = spark.createDataFrame([(i, t, *v) for i, (t, v) in docs.items()], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(list(good.items()), "doc_id long, good int")
    drawn = spark.createDataFrame([(i,) for i in good], "doc_id long").select("doc_id", (F.pmod(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)), F.lit(5)) == 0).alias("c"))
    check = {x.doc_id for x in drawn.collect() if x.c}
    assert 20 < len(check) < len(good) - 60 and {good[i] for i in check} == {0, 1}
    for rounds, confidence in ((0, 0.95), (1, 0.8), (3, 0.7)):
        got = quality.score(frame, quality.learn(frame, labels, ["source", "lang"], rounds=rounds, confidence=confidence)).collect()
        wanted = co_trained(docs, good, check, rounds, confidence)
        for x in got:
            assert np.allclose((x.text_score, x.page_score, x.score), wanted[x.doc_id], rtol=0, atol=1e-9), (rounds, x.doc_id, x, wanted[x.doc_id])
