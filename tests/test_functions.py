"""Examples for the text expressions, chunkers and ordered operators."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketeer.functions import batches, drafting, legal, text
from docketeer.operators import chunking, ingest, layout, ordered, retrieval, workspace
from docketeer.sources import databases, shared


def values(spark, expression, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.select(expression(F.col("x")).alias("v"), "i").orderBy("i").select("v").collect()]


@pytest.mark.parametrize(
    ("title", "name"),
    [
        ("My Draft", "My Draft.md"), ('Bail App: <Test> "v1"/draft?', "Bail App Test v1draft.md"), ("Title\x00with\x1fcontrol", "Titlewithcontrol.md"), ("a/b\\c|d", "abcd.md"),
        ("   spaced   ", "spaced.md"), ("My Doc.", "My Doc.md"), ("My Doc. . .", "My Doc.md"), ("Final Draft.md", "Final Draft.md"), ("Final Draft.MD", "Final Draft.md"),
        ("", "Draft.md"), (None, "Draft.md"), ("<<<>>>", "Draft.md"), ("A" * 500, "A" * 200 + ".md"), ("मराठी मसौदा", "मराठी मसौदा.md"),
    ],
)
def test_safe_filename(spark, title, name):
    assert values(spark, text.safe_filename, title) == [name]


def test_query_text(spark):
    assert values(spark, text.expanded, "IPC in SC", "IPCX", "CrPC CrPC") == ["IPC (Indian Penal Code) in SC (Supreme Court)", "IPCX", "CrPC (Code of Criminal Procedure) CrPC"]
    assert values(spark, text.intent, "What is bail", "Show me one", "how to file", "bail") == ["concept", "example", "question", None]
    assert values(spark, text.is_trivial, "Hello!", "thanks", "bail petition", "why?", "", None, "one two three", "one two three four") == [True, True, False, False, True, True, True, False]


def test_cleaning(spark):
    assert values(spark, text.cleaned, "exam-\nple  “x”  \n########", "a—b") == ['example "x"\n#####', "a—b"]
    assert values(spark, text.code_fence_stripped, '```json\n{"a": 1}\n```', "plain") == ['{"a": 1}', "plain"]
    assert values(spark, text.needs_translation, "ab", "abc", "x@y.org", "---...", "12-166") == [False, True, False, False, True]
    assert values(spark, text.numeric_compact, "12-166", "9/05/2026", "Section 482", "1" * 25) == [True, True, False, False]


def test_legal_patterns(spark):
    assert values(spark, legal.mask_identity, "1234-5678-9012", "uid no 123456789012", "ref 123456789012") == ["XXXX-XXXX-9012", "uid no XXXX-XXXX-9012", "ref 123456789012"]
    assert values(spark, legal.citations, "see (2020) 5 SCC 123 and AIR 2001 SC 14, (2020) 5 SCC 123") == [["(2020) 5 SCC 123", "AIR 2001 SC 14"]]
    draft = "[Loan Amount] [link](u) [To be allotted by Registrar] {{x}} ____ TBD <!-- cause-title:start -->[Court Name]<!-- cause-title:end -->"
    assert values(spark, legal.placeholders, draft) == [["[Loan Amount]", "{{x}}", "____", "TBD"]]
    assert values(spark, legal.paragraph_kind, "Whereas it", "x means y", "He shall", "1. go", "other") == ["preamble", "definition", "provision", "provision", "concept"]
    assert values(spark, legal.role, "Hon'ble Mr. Justice X", "Court Hall 3", "Vs.", "A v B") == ["judge", "hall", "versus", "entry"]


def test_paragraphs_keep_all_words():
    body = "1. " + "word " * 30 + "\n\nshort\n\n(a) " + "Next one here. " * 150 + "\nend"
    parts = chunking.paragraphs(body)
    assert " ".join(parts).split() == body.split()
    assert all(len(p) <= 1200 for p in parts) and all(len(p) >= 80 for p in parts[:-1])
    assert chunking.paragraphs(None) == chunking.paragraphs(" \n\n ") == []
    assert chunking.paragraphs("tiny") == ["tiny"]


def test_pieces_are_lossless():
    for body in ("", "x" * 5000, "line\n" * 900, "A sentence. " * 400, "é" * 1801):
        parts = chunking.pieces(body)
        assert "".join(parts) == body and all(len(p) <= 1800 for p in parts)


def test_packing_of_regions():
    assert chunking.packed(["a" * 10, "b" * 10, "t", "f", "g"], ["body", "body", "title", "footnote", "footnote"], 15) == [[0], [1], [2], [3, 4]]


def test_types_by_path(spark):
    assert values(spark, ingest.mime_type, "a/b.PDF", "x.unknown", "noext", "a.b/c") == ["application/pdf"] + ["application/octet-stream"] * 3
    assert values(spark, ingest.source_type, "a.pdf", "b.JPG", "https://x.org/a.pdf", "c.txt") == ["pdf", "image", None, None]


def test_filters_ignore_empty_values(spark):
    cases = spark.createDataFrame([(1, "High Court", 2000, ["a"]), (2, "Supreme", 2010, ["b"])], "id long, court string, year int, judges array<string>")
    assert retrieval.filter_cases(cases, court="", year_from=0, judge=None).count() == 2
    assert [r.id for r in retrieval.filter_cases(cases, court="high", year_to=2005, judge="a").collect()] == [1]


def test_layered_glossary_and_updates(spark):
    g = lambda *rows: spark.createDataFrame(rows, "term string, translation string")
    assert {r.term: r.translation for r in ingest.layered(g(("a", "1"), ("b", "1")), g(("a", "2"))).collect()} == {"a": "2", "b": "1"}


def test_budget_takes_part_of_the_first_that_overflows(spark):
    files = spark.createDataFrame([("s", i, "x" * n) for i, n in enumerate((500, 400, 300))], "g string, i int, t string")
    rows = ordered.budgeted(files, "g", "i", "t", budget=800, least=200).orderBy("i").collect()
    assert [len(r.taken) for r in rows] == [500, 300]
    assert ordered.budgeted(files, "g", "i", "t", budget=600, least=200).count() == 1


def test_overlap_counts_each_pair_once(spark):
    schema = "page long, id long, x0 double, x1 double, y0 double, y1 double"
    a = spark.createDataFrame([(1, 1, 0.0, 250.0, 0.0, 250.0)], schema)
    b = spark.createDataFrame([(1, 7, 90.0, 210.0, 90.0, 310.0), (1, 8, 250.0, 260.0, 0.0, 9.0), (2, 9, 0.0, 9.0, 0.0, 9.0)], schema.replace("id", "other"))
    assert [r.other for r in layout.overlapping(a, b, "page", 100).collect()] == [7]


def test_database_tables(spark, tmp_path):
    """Written and read through JDBC, with the embedded database that comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1000).select(F.col("id").alias("ID"), (F.col("id") % 7).cast("int").alias("PART"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("NAME"))
    databases.append_table(rows.where("ID < 600"), url, "CASES")
    databases.append_table(rows.where("ID >= 600"), url, "CASES")
    found = databases.database_table(spark, url, "CASES", "ID", parts=4)
    assert found.rdd.getNumPartitions() == 4 and found.count() == 1000
    one = databases.database_table(spark, url, "CASES").where("PART = 3 AND ID > 990")
    assert [r.NAME for r in one.orderBy("ID").collect()] == ["n997"]
    assert "PushedFilters" in one._jdf.queryExecution().toString()


def test_shared_folder_of_a_cluster(spark, monkeypatch):
    spark_conf = type("Conf", (), {"get": staticmethod(lambda key, default: None)})
    fake = lambda master: type("Session", (), {"conf": spark_conf, "sparkContext": type("Context", (), {"master": master, "applicationId": "test"})})
    assert shared.shared_folder(fake("local[4]")) == shared.shared_folder(fake("local"))
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://host:7077"):
        with pytest.raises(ValueError):
            shared.shared_folder(fake(master))


def test_case_names_of_any_length(spark):
    import random
    import re
    import time

    pattern = re.compile(r"(?i)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+v\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*(?:\((\d{4})\))?")
    r = random.Random(5)
    texts = [" ".join(r.choice(["State", "of", "v", "v.", "vs", "Rao", "a", "X2", "(1976)", "and,", "Co-op", "  Union", "\nIndia"]) for _ in range(r.randrange(40))) for _ in range(600)]
    texts += ["word " * 14 + "v. " + "party " * 12 + "(1999)", "word " * 3000 + "v " + "other " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", legal.case_names(F.col("t")).alias("n")).collect()
    for row in rows:
        assert [x.strip() for x in row.n] == [m[0].strip() for m in pattern.finditer(texts[row.i])], texts[row.i]
    long = spark.range(1).select(F.repeat(F.lit("word "), 300_000).alias("t"))
    began = time.time()
    assert long.select(legal.case_names(F.col("t")).alias("n")).first().n == [] and time.time() - began < 30


def test_parts_of_batches(spark):
    texts = [("x" * 300_000 + str(i)) if i % 2 else None for i in range(20)]
    parts = [p for (p,) in batches.parts((pa.array(texts),))]
    assert max(len(p) for p in parts) <= 7 and [x for p in parts for x in p.to_pylist()] == texts
    assert [len(p[0]) for p in batches.parts((pa.array([["a" * 700_000], None, ["b", None] * 10]), pa.array(["c" * 700_000] * 3)))] == [1, 1, 1]
    most = []
    rows = spark.createDataFrame([(i, "y" * 100_000) for i in range(40)], "i int, x string").coalesce(1)
    length = batches.by_parts(lambda a, b: len(a) + len(b), "int", pa.int32())
    most = {r.n for r in rows.select(length(F.col("x"), F.col("x")).alias("n")).collect()}
    assert most == {200_000}


def test_spelling_in_one_pass_as_rule_by_rule(spark):
    import re

    r = random.Random(4)
    words = [*drafting.SPELLING, *drafting.TERMS, "x", "plaintiffs", "IPC,", "bnss."]
    texts = [" ".join(r.choice([str.upper, str.title, str])(w) for w in r.choices(words, k=40)) for _ in range(50)] + ["", None, "nothing here"]
    for rules in (drafting.SPELLING, drafting.TERMS, {"a b": "c", "c": "d", "ab": "c"}):
        wanted = []
        for t in texts:
            for word, to in rules.items():
                t = re.sub(rf"(?i)\b{word}\b", to, t) if t is not None else None
            wanted.append(t)
        assert values(spark, lambda x: drafting.words_replaced(x, rules), *texts) == wanted  # noqa: B023
    assert str(drafting.words_replaced(F.col("t"), drafting.SPELLING)).count("regexp_replace") == 0


def test_embeddings_count_hashes(spark):
    texts = ["b a a", "", "one two three one " * 50, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = [r.v for r in rows.select("i", workspace.hash_embedding(F.col("x")).alias("v")).orderBy("i").collect()]
    words = spark.createDataFrame([(w,) for t in texts if t is not None for w in set(t.split(" "))], "w string")
    number = {r.w: r.h for r in words.select("w", F.xxhash64("w").alias("h")).collect()}
    for text, v in zip(texts, got):
        wanted = [0.0] * 64
        for w in text.split(" ") if text is not None else ():
            wanted[number[w] % 64] += 1 if number[w] > 0 else -1
        assert v == (wanted if text is not None else None)
    assert str(workspace.hash_embedding(F.col("x"))).count("xxhash64") == 1
