"""Row-level changes that take effect whole or not at all; buckets; payloads; text items."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from docketeer.functions import substitution as B
from docketeer.operators import payloads
from docketeer.operators import references as X
from docketeer.sources.bucketed import Bucketed
from docketeer.sources.store import Conflict, Delete, InsertIgnore, Store, Upsert

SCHEMA = "k long, part string, v int"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.create("t", spark.createDataFrame([], SCHEMA).schema, ["k", "part"], buckets=5)
    return s


def held(store, table="t"):
    return sorted((tuple(r) for r in store.read(table).collect()), key=repr)


def test_changes_against_a_dictionary(spark, store):
    r = random.Random(1)
    known = {}
    for step in range(6):
        rows = [(r.choice([None, *range(30)]), r.choice("ab"), r.randrange(100)) for _ in range(20)]
        frame = spark.createDataFrame(rows, SCHEMA)
        best = {}
        for k, p, v in rows:
            best[k, p] = max(v, best.get((k, p), v))
        if step % 3 == 0:
            known |= best
            change = Upsert("t", frame)
        elif step % 3 == 1:
            known = best | known
            change = InsertIgnore("t", frame)
        else:
            known = {x: v for x, v in known.items() if not (x[0] is not None and x[0] % 4 == 1)}
            change = Delete("t", F.col("k") % 4 == 1)
        assert store.apply([change], f"batch {step}")
        assert not store.apply([change], f"batch {step}")
        assert held(store) == sorted(((*x, v) for x, v in known.items()), key=repr)
    before = held(store)
    assert store.vacuum() > 0 and held(store) == before


def test_a_change_that_fails_midway_leaves_all_as_it_was(spark, store):
    store.create("u", spark.createDataFrame([], SCHEMA).schema, ["k"], buckets=3)
    rows = spark.createDataFrame([(i, "a", i) for i in range(50)], SCHEMA)
    store.apply([Upsert("t", rows), Upsert("u", rows)])
    before = held(store), held(store, "u")
    dies = rows.select("k", "part", F.when(F.col("k") == 37, F.raise_error(F.lit("the task dies"))).otherwise(F.col("v")).cast("int").alias("v"))
    with pytest.raises(Exception, match="the task dies"):
        store.apply([Delete("t", F.col("k") < 40), Upsert("u", dies)], "bad")
    assert (held(store), held(store, "u")) == before
    old = store.read("t")
    assert store.apply([Delete("t", F.col("k") < 40), Delete("u", F.col("k") < 40)], "bad")
    assert len(held(store)) == len(held(store, "u")) == 10
    assert old.count() == 50  # a reader keeps what it began with


def test_half_a_manifest_and_another_writer(spark, store, monkeypatch):
    rows = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    store.apply([Upsert("t", rows)])
    number = store.state()["number"]
    other = Store(spark, store.path)
    state = store.state
    calls = []

    def slow():
        found = state()
        if not calls:
            calls.append(other.apply([Upsert("t", rows.withColumn("k", F.lit(2).cast("long")))]))
        return found

    monkeypatch.setattr(store, "state", slow)
    assert store.apply([Upsert("t", rows.withColumn("k", F.lit(3).cast("long")))])
    assert [r[0] for r in held(other)] == [1, 2, 3] and other.state()["number"] == number + 2
    calls.clear()
    with pytest.raises(Conflict):
        store.apply([Delete("t", F.lit(True))], attempts=1)
    with open(f"{store.path}/manifests/{number + 9:012d}.json", "w") as f:
        f.write('{"number": 99, "tab')
    assert [r[0] for r in held(Store(spark, store.path))] == [1, 2, 3]
    assert all(json.load(open(f"{store.path}/manifests/{n}")) for n in os.listdir(f"{store.path}/manifests") if n.endswith(".json") and not n.startswith(f"{number + 9:012d}"))


def test_joins_of_buckets_need_no_exchange(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 7 % 11).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Bucketed(spark, 8) as b:
            left, right = b.write(rows, "k"), b.write(rows.withColumnRenamed("v", "w"), "k")
            plan = left.join(right, "k")
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in text and "SortMergeJoin" in text and plan.count() == 5000
            spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't say
            one = left.where("k = 4321")
            assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1
            names = b.names
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert not any(spark.catalog.tableExists(n) for n in names) and not os.path.exists(b.folder)


def test_payload_fields(spark):
    texts = ['{"metadata": {"file_id": "f", "page_number": "7"}}', '{"payload": {"metadata": {"file_id": "g", "page_number": 8.0}}}', '{"point": {"document_id": 5}}', '{"metadata": {"page_number": "x", "file_id": null}}', "[1]", "no", "", None, '{"metadata": "text"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", payloads.payload(F.col("t")).alias("payload"))
    got = {r.id: (r.file_id, r.page_number, r.document_id) for r in payloads.flat(rows).collect()}
    none = (None, None, None)
    assert got == {0: ("f", 7, None), 1: ("g", 8, None), 2: (None, None, "5"), 3: none, 4: none, 5: none, 6: none, 7: none, 8: none}
    assert [r.id for r in payloads.scrolled(rows, 5, metadata__file_id="g", metadata__page_number=8).collect()] == [1]


def values(spark, column, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in frame.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_tags_come_back_wherever_they_are(spark):
    assert values(spark, B.protected, ["a<strong >b</STRONG>c<br/>", "", "<i>x</i>", None])[:3] == [
        ("a[__VTAG_0000__]b[__VTAG_0001__]c[__VTAG_0002__]", ["<strong >", "</STRONG>", "<br/>"]), ("", []), ("<i>x</i>", []),
    ]
    back = lambda t: B.restored(t, F.array(F.lit("<u>"), F.lit("</u>")))
    assert values(spark, back, ["[__VTAG_0001__] z [__VTAG_0000__][__VTAG_0000__]", "[__VTAG_0002__][__VTAG_1__]", "", None]) == ["</u> z <u><u>", "[__VTAG_0002__][__VTAG_1__]", "", None]
    many = "<em>" * 12_345
    assert values(spark, lambda t: B.restored(B.protected(t)["text"], B.protected(t)["tags"]), [many[: 4 * 9_999]])[0] == many[: 4 * 9_999]


def test_amounts(spark):
    texts = ["1 million", "2.5Million and 3 BILLION", "0.25 million, 1.234567 million", "millions 5 millionaire", "12 billion million", "123456.789 million", "0 million", None]
    wanted = ["10 लाख", "25 लाख and 300 करोड़", "2.5 लाख, 12.3457 लाख", "millions 5 millionaire", "1200 करोड़ million", "1.23457e+06 लाख", "0 लाख", None]
    assert values(spark, B.local_units, texts) == wanted
    exact = lambda t: B.local_units(t, exact=True)
    assert values(spark, exact, ["1000.025billion", "40001 Million, 0.25 million", "1234567.125 million", "0 billion", None]) == ["100002.5 करोड़", "400010 लाख, 2.5 लाख", "12345671.25 लाख", "0 करोड़", None]
    assert str(B.local_units(F.col("t"))).count("regexp_extract_all") == 2  # each text is computed once
    for v in (0.1, 12.5, 123456.5, 999999.5, 1234567.5, 0.015, 2.0, 10**9 + 0.5):
        assert values(spark, lambda t: B.short_number(t.cast("double")), [str(v)])[0] == (str(int(v)) if v == int(v) else f"{v:g}"), v


def test_waits(spark):
    rows = spark.createDataFrame([(429, 0, "7"), (429, 3, None), (500, 3, "soon"), (500, 99, None), (503, 1, " 500 "), (429, 50, "")], "status int, attempt int, header string")
    got = [r.w for r in rows.select(B.wait_seconds(F.col("status"), F.col("attempt"), F.lit(1.5), F.col("header")).alias("w")).collect()]
    assert got == pytest.approx([7.0, 1.5 * 2.5**3, 12.0, 60.0, 120.0, 60.0])
    messages = ["try again in 250ms", "Try again in 3 s", "retry_delay { seconds: 9 s", "RetryDelay: 4.5s", "try again in 0ms", "no", None]
    assert values(spark, B.retry_after, messages) == [0.25, 3.0, 9.0, 4.5, 0.001, None, None]
    limited = lambda t: B.rate_limited(F.lit(None).cast("int"), t)
    assert values(spark, limited, ["Error 429", "Rate Limit!", "RESOURCE_EXHAUSTED", "fine", None]) == [True, True, True, False, False]


def test_replies_in_records(spark):
    texts = ["""a {'title': 'x', 'content': 'it\\'s\\nso'} b {"content": "c"}""", "{'content': ''}", "content: x", "{'other': 1, 'content': 'x'}", None]
    assert values(spark, B.unwrapped, texts) == ["""a it's\nso b {"content": "c"}""", "", "content: x", "{'other': 1, 'content': 'x'}", None]


def test_references_of_blocks_go_back_to_their_places(spark):
    s = lambda t, bold=False: (t, bold, None)
    blocks = spark.createDataFrame(
        [
            (1, 0, 0, "text", [s("ab", True), s("c")], None, None, None), (1, 0, 1, "row", None, [s("l")], [s("r")], None), (1, 1, 0, "table", None, None, None, [[[s("x")], [s("y"), s("z")]], [[]]]),
            (1, 1, 1, "image", None, None, None, None), (2, 0, 0, "row", [s("odd")], None, [s("r")], None), (2, 0, 1, "text", [], None, None, None),
        ],
        X.BLOCK,
    )
    refs = X.references(blocks)
    key = lambda frame: {(r.doc_id, r.page, r.block, r.side): (r.text, r.bold, r.italic) for r in frame.collect()}
    wanted = {
        (1, 0, 0, "spans"): ("abc", True, False), (1, 0, 1, "left"): ("l", False, False), (1, 0, 1, "right"): ("r", False, False), (1, 1, 0, "cell:0:0"): ("x", False, False),
        (1, 1, 0, "cell:0:1"): ("yz", False, False), (1, 1, 0, "cell:1:0"): ("", False, False), (2, 0, 0, "right"): ("r", False, False), (2, 0, 1, "spans"): ("", False, False),
    }
    assert key(refs) == wanted
    back = X.written_back(blocks, refs.where("side <> 'left'").withColumn("text", F.upper("text")))
    assert back.columns == blocks.columns and back.count() == blocks.count()
    assert key(X.references(back)) == {k: (t if k[3] == "left" else t.upper(), b, i) for k, (t, b, i) in wanted.items()}
    assert back.where("doc_id = 2 AND block = 0").first().spans[0].text == "odd"
