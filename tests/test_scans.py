"""Running values over one group of all rows, substring joins, sketches, table functions."""

import random
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketeer.operators import folds, layout, ordered, quantiles, scans, substring_join
from docketeer.operators.substring_join import contained


def cause(spark, groups, n=3000, seed=1):
    r = random.Random(seed)
    rows = [(r.choice(groups), i, f"J{r.randrange(9)}" if r.random() < 0.01 else None, f"H{r.randrange(3)}" if r.random() < 0.002 else None, r.randrange(50)) for i in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "page long, row_no long, judge string, hall string, size int"), rows


def filled(rows):
    last, out = {}, []
    for page, n, judge, hall, _ in sorted(rows, key=lambda x: x[1]):
        j, h = last.get(page, (None, None))
        last[page] = (judge or j, hall or h)
        out.append((page, n, *last[page]))
    return out


@pytest.mark.parametrize("groups", [[7], [1, 2], [None, 5], list(range(40)), [None]])
def test_forward_fill_of_groups_of_any_size(spark, groups):
    frame, rows = cause(spark, groups)
    got = scans.forward_filled(frame, "page", ["row_no"], ["judge", "hall"])
    assert set(got.columns) == {"page", "row_no", "judge", "hall", "size"}
    assert sorted(((r.page, r.row_no, r.judge, r.hall) for r in got.collect()), key=lambda x: x[1]) == filled(rows)


def test_a_single_group_uses_all_tasks(spark):
    frame, rows = cause(spark, [7], 40_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scans.forward_filled(frame, "page", ["row_no"], ["judge", "hall"]).withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in got.groupBy("task").count().collect()]
        used = scans.budgeted(frame.withColumn("text", F.lit("abc")), "page", ["row_no"], "text", budget=10**9).withColumn("task", F.spark_partition_id())
        others = [r["count"] for r in used.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for held in (tasks, others):
        assert sum(held) == 40_000 and len(held) >= 2 and max(held) < 0.8 * 40_000, held


@pytest.mark.parametrize("groups", [[7], [None, 1, 2]])
def test_running_totals_budgets_and_pairs(spark, groups):
    frame, rows = cause(spark, groups, 2000)
    got = {r.row_no: r.total for r in scans.running_total(frame, "page", ["row_no"], F.col("size"), "total").collect()}
    for g in groups:
        own = sorted((r for r in rows if r[0] == g), key=lambda x: x[1])
        assert [got[r[1]] for r in own] == [0, *list(accumulate(r[4] for r in own))][:-1]
    texts = frame.withColumn("text", F.repeat(F.lit("x"), F.col("size")))
    a = scans.budgeted(texts, "page", ["row_no"], "text", 5000, 10)
    b = ordered.budgeted(texts, "page", "row_no", "text", 5000, 10)
    key = lambda frame: sorted(map(repr, frame.select("page", "row_no", "taken").collect()))
    assert key(a) == key(b) and a.count() > 0
    start, other = F.col("size") < 5, F.col("judge").isNotNull()
    key = lambda frame: sorted(map(repr, frame.select("page", F.col("entry").cast("long").alias("entry"), "petitioner_row", "respondent_row").collect()))
    assert key(scans.paired(frame, "page", "row_no", start, other)) == key(ordered.paired(frame, "page", "row_no", start, other))


def test_scans_of_empty_tables(spark):
    frame, _ = cause(spark, [1], 0 + 1)
    empty = frame.limit(0)
    assert scans.forward_filled(empty, "page", ["row_no"], ["judge"]).count() == 0
    assert scans.running_total(empty, "page", ["row_no"], F.col("size"), "t").count() == 0


# ---- substrings ----


@pytest.mark.parametrize("q", [1, 3, 4])
def test_contained_terms_against_all_pairs(spark, q):
    r = random.Random(q)
    word = lambda a, b: "".join(r.choice("ab é.*$\\\n") for _ in range(r.randrange(a, b)))
    texts = [(i, word(0, 60)) for i in range(150)] + [(3, "aba"), (None, "ab ab"), (None, None), (None, "bb"), (200, "a" * 5000 + "é.*")]
    terms = {word(0, 9) for _ in range(80)} | {"", "a" * 4000, "é.*"}
    got = contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in sorted(terms)] * 2 + [(None,)], "term string"), q=q)
    wanted = {(i, t) for i, x in texts if x is not None for t in terms if t and t in x}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == wanted and len([x for x in rows if x[0] not in (3, None)]) == len({x for x in wanted if x[0] not in (3, None)})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ten_thousand_terms(spark):
    r = random.Random(9)
    terms = {"".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(10_000)}
    some = sorted(terms)[::50]
    texts = [(i, "x" + t + some[-i - 1]) for i, t in enumerate(some)]
    got = contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {tuple(x) for x in got.collect()} >= {(i, t) for i, t in enumerate(some)}
    none = spark.createDataFrame([], "term string")
    assert contained(spark.createDataFrame(texts, "id long, text string"), none).count() == 0


# ---- sketches ----


def test_merged_sketches_within_their_bound(spark):
    r = np.random.default_rng(5)
    values = np.round(r.lognormal(2, 1, 60_000), 3)
    rows = spark.createDataFrame([(i % 30, i % 3, float(v)) for i, v in enumerate(values)], "page int, file int, size double").withColumns({"x0": F.col("size"), "x1": F.col("size")})
    columns = ["size", "x0", "x1"]
    pages = quantiles.sketched(rows, ["file", "page"], columns)
    for keys in (["file"], ["all"]):
        sketches = quantiles.merged(pages.withColumn("all", F.lit(0)), keys, columns)
        for row in quantiles.measures(sketches, keys).collect():
            own = np.sort(values[np.arange(len(values)) % 3 == row.file] if keys == ["file"] else values)
            assert row.n == len(own)
            for got, q in ((row.median_size, 0.5), (row.left_margin, 0.05), (row.right_margin, 0.95)):
                low, high = np.searchsorted(own, got, "left") / len(own), np.searchsorted(own, got, "right") / len(own)
                assert low - 2 * quantiles.RANK_ERROR <= q <= high + 2 * quantiles.RANK_ERROR
    assert pages.agg(F.max(F.octet_length("size"))).first()[0] < 10_000


def test_exact_percentiles(spark):
    r = np.random.default_rng(6)
    rows = [(int(i % 3), float(np.round(v, 1)) if i % 11 else None) for i, v in enumerate(r.normal(0, 5, 2000))] + [(7, 4.5), (8, None), (None, 1.0), (None, 2.0)]
    wanted = {"a": ("v", 0.5), "b": ("v", 0.05), "c": ("v", 0.95), "d": ("v", 0.0), "e": ("v", 1.0)}
    got = {x.k: tuple(x[n] for n in wanted) for x in layout.percentiles(spark.createDataFrame(rows, "k long, v double"), "k", wanted).collect()}
    assert got.keys() == {0, 1, 2, 7}  | ({None} if None in got else set())
    for k in (0, 1, 2, 7):
        own = [v for key, v in rows if key == k and v is not None]
        assert got[k] == pytest.approx([np.quantile(own, q) for _, q in wanted.values()], abs=1e-9)


# ---- table functions ----


def test_packed_regions_in_order(spark):
    r = random.Random(2)
    roles = ["body", "footnote", "title", "heading", "table", None]
    rows = [(d, p, r.choice(roles), None if r.random() < 0.05 else "x" * r.randrange(900)) for d in (1, 2, None) for p in range(200)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    got = {(x.doc, x.place): x.batch for x in folds.packed(spark.createDataFrame(shuffled, "doc long, place long, role string, text string"), 1800).collect()}
    for d in (1, 2, None):
        batch, size, kind = -1, 0, None
        for _, p, role, text in (x for x in rows if x[0] == d):
            own = "footnote" if role == "footnote" else role if role in ("title", "heading", "table") else "body"
            n = len(text or "")
            if batch < 0 or own in ("title", "heading", "table") or own != kind or size + n > 1800:
                batch, size, kind = batch + 1, 0, own
            size += n
            assert got[d, p] == batch, (d, p)
    with pytest.raises(Exception, match="lack"):
        folds.packed_regions(spark.createDataFrame(rows[:3], "doc long, place long, kind string, text string").asTable(), F.lit(5)).collect()


def test_a_group_of_many_rows_goes_through(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("doc"), F.col("id").alias("place"), F.lit("body").alias("role"), F.lit("x" * 10).alias("text"))
    assert folds.packed(rows, 100).agg(F.max("batch")).first()[0] == 29_999


@pytest.mark.parametrize("most", [200_000, 0])
def test_terms_around_their_keys(spark, most):
    r = random.Random(6)
    letters = ["a", "b", "ab", "é", "𝒳", "धा", " ", "\n", "Ab"]
    texts = ["".join(r.choices(letters, k=r.randrange(60))) for _ in range(150)] + [None, "", "ab"]
    terms = ["".join(r.choices(letters, k=r.randrange(1, 9))) for _ in range(120)] + [None, "", "ab", "ab", "x" * 30]
    ids = [i // 2 if i % 5 else None for i in range(len(texts))]
    rows = list(zip(ids, texts))
    found = substring_join.contained(spark.createDataFrame(rows + rows[:20], "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), sample=40, most_shapes=most)
    wanted = [(i, t) for i, x in set(rows) if x is not None for t in set(terms) if t and t in x]
    assert sorted(map(repr, (tuple(x) for x in found.collect()))) == sorted(map(repr, wanted))
    if most:
        assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
