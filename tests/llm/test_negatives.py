import numpy as np
import pytest
from pyspark.sql import functions as F

from docketeer.llm import negatives

SCHEMA = "id long, label long, vector array<long>"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def order(i):
    return (i is None, i or 0)


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """All scores, with whole numbers of any size."""
    rows = [(i, l, v) for i, l, v in rows if l is not None and v is not None and None not in v]
    out = []
    for k, (i, l, v) in enumerate(rows):
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m) for n, (j, m, w) in enumerate(rows) if n != k]
        best = sorted(((s, j) for s, j, m in scored if m == l), key=lambda x: (-x[0], order(x[1])))[:positives]
        for s, j in best:
            kept = sorted(((t, n) for t, n, m in scored if m != l and low * s <= 100 * t <= high * s), key=lambda x: (-x[0], order(x[1])))
            out += [(i, j, r, n, s, t) for r, (t, n) in enumerate(kept[:negatives], 1)]
    return sorted(out, key=lambda x: [order(y) for y in x])


def got(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", rank string")
    found = negatives.hard_negatives(frame, F.col("id") % 5 == 0, **options)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=lambda x: [order(y) for y in x])


@pytest.mark.parametrize("options", [{}, {"pivots": 1, "sample": 3}, {"chunk": 7, "pivots": 40}, {"positives": 2, "negatives": 1, "low": 0, "high": 100}])
@pytest.mark.parametrize("spread", [4, 60, 100_000_000])
def test_negatives_against_all_scores(spark, options, spread):
    r = np.random.default_rng(spread)
    centres = r.integers(-spread, spread, (6, 5))
    rows = []
    for i in range(260):
        c = int(r.integers(6))
        rows.append((int(r.integers(0, 220)), int(r.integers(0, 3)), (centres[c] + r.integers(-spread // 8 - 1, spread // 8 + 2, 5)).tolist()))
    rows += [rows[3], rows[3], (None, 1, rows[5][2]), (None, None, rows[5][2]), (5, 1, None), (10, 1, [1, None, 2]), (15, 2, []), (20, 0, [7, 7]), (25, 0, [0] * 5)]
    small = {k: v for k, v in options.items() if k in ("positives", "negatives", "low", "high")}
    assert got(spark, rows, **options) == brute(rows, lambda i: i % 5 == 0, **small)


def test_few_rows_and_one_label(spark):
    assert got(spark, []) == []
    assert got(spark, [(5, 1, [1, 2])]) == []
    assert got(spark, [(5, 1, [1, 2]), (6, 1, [1, 2])]) == []
    assert got(spark, [(6, 1, [1, 2]), (7, 2, [1, 2])]) == []
    assert got(spark, [(5, 1, [2, 2]), (6, 1, [2, 2]), (7, 2, [1, 1]), (8, 2, [2, 2])]) == [(5, 6, 1, 7, 8, 4)]
    assert got(spark, [(5, 1, []), (6, 1, []), (7, 2, [])]) == [(5, 6, 1, 7, 0, 0)]


def test_a_large_group_of_equal_vectors(spark):
    rows = [(i, i % 2, [3, 4, 5]) for i in range(1500)] + [(i, i % 3, [2, 2, i % 7]) for i in range(1500, 1600)]
    anchors = [r for r in rows if r[0] % 5 == 0]
    found = got(spark, rows)
    assert len({r[0] for r in found}) == len([a for a in anchors if a[0] < 1500]) + len({r[0] for r in found if r[0] >= 1500})
    some = {5, 750, 1500, 1555}
    assert [r for r in found if r[0] in some] == brute(rows, lambda i: i in some)


def test_pivots_rule_tiles_out_where_vectors_lie_in_groups():
    r = np.random.default_rng(1)
    centres = r.integers(-1000, 1000, (40, 8))
    x = np.repeat(centres, 400, axis=0) + r.integers(-10, 10, (16_000, 8))
    most = float((x * x).sum(1).max())
    space = negatives.Space(8, most, True).with_pivots(x[:: 7], 40)
    d = space.distances(space.augmented(x))
    near = np.lexsort((d.min(1), d.argmin(1)))
    x, d = x[near], d[near]
    labels = np.arange(len(x)) % 4
    rows = negatives.Rows(np.arange(len(x)), np.arange(len(x)), labels, space.numbers(x), d)
    anchors = rows.cut(0, len(x))
    anchors = negatives.Rows(*(c[::500] for c in (anchors.row, anchors.id, anchors.label, anchors.x, anchors.distance)))
    n = len(anchors.id)
    low, high = np.full(n, negatives.LEAST), np.full(n, negatives.MOST)
    asked = negatives.Asked(anchors, True, 5, np.arange(n), low, high, low)
    best = negatives.Best(negatives.bounded(asked, space, negatives.Rows(*(c[::20] for c in (rows.row, rows.id, rows.label, rows.x, rows.distance)))), space)
    best.see(rows)
    q, s, i = best.settle()
    assert best.seen == n * len(x) and best.checked < best.seen / 4
    for k in range(n):
        scores = x @ x[anchors.id[k]]
        own = [j for j in np.lexsort((np.arange(len(x)), -scores)) if labels[j] == anchors.label[k] and j != anchors.id[k]][:5]
        assert i[q == k].tolist() == own and s[q == k].tolist() == scores[own].tolist()
