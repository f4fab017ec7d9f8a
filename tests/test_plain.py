"""The queries that SQL can't express, row by row against plain Python over whole tables."""

import random
from functools import reduce
from pathlib import Path

import duckdb
import plain
import pytest
from pyspark.sql import functions as F

from docketeer.functions import differences, translation
from docketeer.operators import assembly, chunking
from docketeer.plans import QUERIES

DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="the driver's tables are not here")


def rows(sql):
    return duckdb.sql(sql.replace("FROM ", f"FROM '{DIR}/").replace(" ;", ".parquet'")).fetchall()


@pytest.fixture(scope="module")
def docs():
    return dict(rows("SELECT doc_id, text FROM documents ;"))


@pytest.fixture(scope="module")
def pages():
    return dict(rows("SELECT page_id, html FROM pages ;"))


def got(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in QUERIES[name].plan(spark, DIR).collect())


def test_source_cleanup(spark, docs):
    assert got(spark, "source_cleanup", "doc_id", "text") == sorted((d, plain.cleaned(t + " ######## exam-\nple  x ")) for d, t in docs.items())


def test_paragraph_chunks(spark, docs):
    wanted = [(d, i, p) for d, t in docs.items() for i, p in enumerate(plain.paragraphs("1. " + t.replace("\n", "\n\n2. ")), 1)]
    found = got(spark, "paragraph_chunks", "doc_id", "n", "chunk")
    assert found == sorted(wanted)
    assert {r.chunk_id for r in QUERIES["paragraph_chunks"].plan(spark, DIR).collect()} == {f"{d}_p{n}" for d, n, _ in wanted}


def test_paragraphs_of_many_shapes():
    r = random.Random(1)
    parts = ["\n", "\n\n", " \n \n", "1. item", "a) x ", "(b) y ", "12) z", "Some words here. And more (so) it goes! ", "short", "A" * 70 + ". ", "tail "]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert chunking.paragraphs(text) == plain.paragraphs(text), text


def test_region_pack(spark):
    talks = {}
    for conv, turn, role, text in sorted(rows("SELECT conv_id, turn, role, text FROM conversations ;")):
        talks.setdefault(conv, []).append((role, text))
    wanted = [(c, i, len(b), ",".join(map(str, b))) for c, ms in talks.items() for i, b in enumerate(plain.batches(ms, 1800))]
    assert got(spark, "region_pack", "conv_id", "batch", "n", "members") == sorted(wanted)


def test_semantic_chunks(spark, docs):
    assert got(spark, "semantic_chunks", "doc_id", "n", "chunk") == sorted((d, i, c) for d, t in docs.items() for i, c in enumerate(plain.semantic(t), 1))


def test_html(spark, pages):
    assert got(spark, "html_to_blocks", "page_id", "n", "kind", "text") == sorted((p, i, k, t) for p, h in pages.items() for i, (k, t) in enumerate(plain.blocks(h)))
    tail = "<strong>x</strong><script>bad()</script> <foo>&amp; </foo>"
    assert got(spark, "inline_sanitise", "page_id", "t") == sorted((p, plain.inline(f"{h}{tail}{p}")) for p, h in pages.items())


def test_ingestion_status(spark, docs):
    wanted = []
    for d, t in docs.items():
        kind, n = ("pdf", "image", None)[d % 3], len(plain.paragraphs(t))
        reason = "unsupported type" if kind is None else "no text" if n == 0 else None
        wanted.append((d, kind, 0 if kind is None else n, "failed" if reason else "completed", reason))
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r[c] for c in ("file_id", "kind", "n_chunks", "status", "reason"))) for r in QUERIES["ingestion_status"].plan(spark, DIR).collect())


def test_candidate_terms(spark):
    english = rows("SELECT doc_id, text FROM documents ; WHERE lang = 'en'")
    assert got(spark, "candidate_terms", "page", "pos", "term") == sorted(plain.terms(english))


def test_repeats_and_wrapped_lines(spark, docs):
    tail = lambda d: f" of the court of the court in {d} cases in {d} cases"
    assert got(spark, "repeat_collapse", "doc_id", "t") == sorted((d, "\n".join(map(plain.without_repeats, (t + tail(d)).split("\n")))) for d, t in docs.items())
    assert got(spark, "wrapped_lines", "doc_id", "t") == sorted((d, plain.unwrapped(f"{t}\nThe order was\npassed {d} days\nago.\nNext")) for d, t in docs.items())


def test_repeats_of_random_tokens():
    r = random.Random(2)
    for most in (6, 20):
        for _ in range(2000):
            line = " ".join(r.choice(["a", "A", "b", "", "c d"]) for _ in range(r.randint(0, 60)))
            for exempt in ((), ("a",), ("b c",)):
                assert translation.collapsed(line, most, exempt) == plain.without_repeats(line, most, exempt), line
    assert translation.collapsed("x y " * 200_000, 6).count("x") < 200_001  # a very long line ends
    assert translation.collapsed("the court of the court of the court of", 6) == "the court of the court of"


def test_digits_words_and_reports(spark):
    frame = spark.createDataFrame([(0, "धारा 12 और 3, https://x.in/45 AIR 2001 SC 7 ९8"), (1, "क ि ा ख  ा a ा"), (2, None)], "i int, t string").orderBy("i")
    assert [x.v for x in frame.select(translation.devanagari_digits(F.col("t")).alias("v")).collect()] == ["धारा १२ और ३, https://x.in/45 AIR 2001 SC ७ ९8", "क ि ा ख  ा a ा", None]
    assert [x.v for x in frame.select(translation.rejoined_words(F.col("t")).alias("v")).collect()][1] == "किा ख  ा a ा"
    passes = [("double", "  +", " "), ("digits", "[0-9]", "#")]
    got = [(x.v.text, x.v.report) for x in frame.select(translation.reported(F.col("t"), passes).alias("v")).collect()]
    assert got[1:] == [("क ि ा ख ा a ा", {"double": 1, "digits": 0}), (None, {"double": 0, "digits": 0})] and got[0][1] == {"double": 0, "digits": 11}


def test_edits_and_quotes(spark):
    edits = [(5, 5, "+"), (0, 2, "A"), (1, 3, "late"), (5, 6, "B"), (40, 50, "out")]
    assert translation.edited("abcdefgh", edits) == "Acde+Bgh"
    assert translation.edited("ab[__0001__]cd __KEEP_0__", [(0, 3, "x"), (12, 13, "y"), (16, 18, "z"), (2, 2, "!")]) == "ab![__0001__]yd __KEEP_0__"
    assert translation.curled('"धारा" "abc" क"x"ख, "a धा') == '“धारा” "abc" क“x”ख, "a धा'
    assert translation.curled('""क क"abcdefgh" "x') == '"“क क”abcdefgh" "x'
    row = spark.sql("SELECT 'abc' AS t, 'broken' AS e").select(translation.with_edits(F.col("t"), F.col("e")).alias("t"), translation.with_edits(F.lit(None).cast("string"), F.lit("[]")).alias("n")).first()
    assert (row.t, row.n) == ("abc", None)


def test_changes_between_texts():
    r = random.Random(3)
    for size in (20, 300, 3000):
        for _ in range(60):
            before = " ".join(r.choice(["law", "court", f"w{r.randrange(size)}", "a\nb"]) for _ in range(r.randint(0, size)))
            after = before
            for _ in range(r.randint(0, 4)):
                at = r.randint(0, len(after))
                after = after[:at] + r.choice(["", "§new§", "x"]) + after[at + r.choice([0, 0, 5]) :]
            found = differences.joined(differences.spans(before, after))
            same = "".join(c for i, c in enumerate(after) if not any(a <= i < b for a, b in found))
            rest = iter(before)
            assert all(c in rest for c in same) and all(any(a <= i < b for a, b in found) for i, c in enumerate(after) if c == "§")
            assert bool(found) == (before != after) and sum(b - a for a, b in found) <= 60
    assert differences.joined(differences.spans("the cat sat", "the car sat down")) == [(6, 7), (11, 16)]
    assert differences.joined(differences.spans("the old cat", "the cat")) == [(4, 4)] and list(differences.spans("", "")) == []
    words = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    other = words[:30_000] + ["new"] + words[30_000:]
    assert differences.joined(differences.spans(" ".join(words), " ".join(other)))  # a long text ends


def test_two_column_assembly(spark):
    lines = rows("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem ;")
    blocks = {}
    for order, number, part, supp, quantity, flag in lines:
        y, x0 = (number - number % 2) * 10.0 + part % 5, (40.0, 320.0, 150.0)[supp % 3]
        text = "" if quantity < 3 else f"{flag}-{supp}" + (" " if part % 4 == 0 else "")
        blocks.setdefault(order, []).append((number * 1_000_000 + part, x0, y, x0 + quantity * 4, y + 10, quantity / 4, text))
    wanted = []
    for block, own in blocks.items():
        heights, items, pending = [], [], []
        for line in sorted(own):
            if line[6]:
                fits = [h for h in heights if abs(line[2] + 5 - sum(x[2] + 5 for x in h) / len(h)) < 6]
                if fits:
                    fits[-1].append(line)
                else:
                    heights.append([line])

        def text_of(held):
            return reduce(lambda a, b: a + ("" if a.endswith(" ") or b.startswith(" ") else " ") + b, [x[6] for x in held])

        def flush():
            if pending:
                items.append(("text", text_of(pending), None, None, min(x[1] for x in pending), max(x[3] for x in pending), max(x[5] for x in pending)))  # noqa: B023
                pending.clear()  # noqa: B023

        for held in heights:
            left, right = [x for x in held if x[3] <= 312], [x for x in held if x[1] >= 288]
            if len(held) > 1 and left and right and max(x[3] for x in left) < min(x[1] for x in right):
                flush()
                items.append(("row", None, text_of(left), text_of(right), min(x[1] for x in held), max(x[3] for x in held), None))
            else:
                pending += held
        flush()
        wanted += [(block, n, *i) for n, i in enumerate(items)]
    assert got(spark, "two_column_assembly", "block", "item", "kind", "text", "left", "right", "x0", "x1", "size") == sorted(wanted)
    assert {w[2] for w in wanted} == {"row", "text"}


def test_sections_of_odd_documents(spark):
    frame = spark.createDataFrame([(1, 0, "a."), (1, 1, "Head"), (1, 2, "b."), (1, 3, None), (1, 4, "Head"), (2, 0, "Top"), (3, 0, "x."), (None, 0, "Top"), (None, 1, "y.")], "d long, n long, t string")
    found = assembly.sections(frame, "d", "n", "t", ~F.endswith("t", F.lit(".")))
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, [(1, 0, None, "a."), (1, 1, "Head", "b."), (1, 2, "Head", ""), (2, 1, "Top", ""), (3, 0, None, "x."), (None, 1, "Top", "y.")]))
    assert assembly.sections(frame.limit(0), "d", "n", "t", F.lit(True)).count() == 0


def test_echoes(spark, docs):
    def echo(t):
        last = " ".join(t.split("\n")[-1].split(" ")[:20])
        return f"{t}\n{last} {last} the end the end"

    assert got(spark, "echoes_removed", "doc_id", "t") == sorted((d, "\n".join(plain.without_repeats(line, 20, ("end",)) for line in echo(t).split("\n"))) for d, t in docs.items())


def test_batches_of_regions(spark):
    talks = {}
    for conv, turn, role, text in sorted(rows("SELECT conv_id, turn, role, text FROM conversations ;")):
        talks.setdefault(conv, []).append((turn, "heading" if role == "system" else "body", text))
    wanted = [(c, own[i][0], n) for c, own in talks.items() for n, held in enumerate(chunking.packed([t for _, _, t in own], [r for _, r, _ in own], 1800)) for i in held]
    assert got(spark, "region_pack_rows", "doc", "place", "batch") == sorted(wanted)


def test_sketches_of_pages_files_and_all(spark):
    spans = [(order % 50, 8 + quantity / 10, float(supp % 500)) for order, quantity, supp in rows("SELECT l_orderkey, l_quantity, l_suppkey FROM lineitem ;")]
    found = QUERIES["font_sketches"].plan(spark, DIR).collect()
    assert len(found) == 50 + 5 + 1
    for r in found:
        own = [(size, x0) for page, size, x0 in spans if (r.page is None or page == r.page) and (r.file is None or page // 10 == r.file)]
        assert r.n == len(own)
        for value, q, k in ((r.median_size, 0.5, 0), (r.left_margin, 0.05, 1)):
            below, upto = sum(o[k] < value for o in own) / r.n, sum(o[k] <= value for o in own) / r.n
            assert below - 0.03 <= q <= upto + 0.03
