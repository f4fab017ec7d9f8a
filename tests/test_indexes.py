"""Vectors by cell and postings of stems against scans and plain Python."""

import math
import re
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docketeer.functions import stemming
from docketeer.functions.vectors import cosine_distance, literal
from docketeer.operators import lexical_index, vector_layout
from docketeer.plans import QUERIES, indexes, retrieval

DIR = "/root/testdata/sf0.001"

# published examples of the stemmer
EXAMPLES = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consolation consol
consolatory consolatori consolidate consolid consoling consol conspicuously conspicu conspiracy conspiraci conspirators conspir constable constabl constancy constanc knack knack knackeries knackeri
kneeled kneel knightly knight knives knive knocker knocker knopp knopp caresses caress ponies poni ties tie cries cri gas gas this this gaps gap kiwis kiwi hoping hope hopping hop falling fall
luxuriated luxuri generously generous generalization general communism communism skies sky dying die news news succeed succeed proceed proceed inning inning relational relat rational ration
happily happili nationally nation appeals appeal appealed appeal appealing appeal appellant appel youth youth boyish boyish sayings say""".split()


@pytest.mark.parametrize(("word", "wanted"), list(zip(EXAMPLES[::2], EXAMPLES[1::2])))
def test_published_stems(word, wanted):
    assert stemming.stem(word) == wanted


def clustered(spark, n=4000, dim=12, groups=40):
    r = np.random.default_rng(3)
    centres = r.normal(size=(groups, dim))
    rows = [(i, i % 3, (centres[i % groups] + 0.05 * r.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(n, 0, None), (n + 1, 0, [0.0] * dim), (n + 2, 1, rows[5][2]), (n + 3, 1, [-x for x in rows[5][2]])]
    return spark.createDataFrame(rows, "id long, label int, embedding array<double>"), rows


def scan(rows, vector, k, label=None):
    def distance(v):
        size = math.dist(v, [0] * len(v)) * math.dist(vector, [0] * len(vector)) if v else 0
        return round(1 - (sum(a * b for a, b in zip(v, vector)) / size if size else 0.0), 9)

    return sorted((distance(v), i) for i, l, v in rows if label is None or l == label)[:k]


def test_cells_give_what_a_scan_gives_and_most_are_not_read(spark, tmp_path):
    frame, rows = clustered(spark)
    vector_layout.write_cells(frame, str(tmp_path / "v"), cells=40, sample=1000)
    layout = vector_layout.VectorLayout(spark, str(tmp_path / "v"))
    assert sum(c.n for c in layout.cells) == len(rows)
    for k, number in ((1, 0), (10, 7), (100, 555)):
        found = layout.search(rows[number][2], k)
        wanted, got = scan(rows, rows[number][2], k), found.collect()
        assert [r.id for r in got] == [i for _, i in wanted] and [r.distance for r in got] == pytest.approx([d for d, _ in wanted])
    only = layout.search(rows[7][2], 500, lambda x: x.where("label = 1"))
    assert [r.id for r in only.collect()] == [i for _, i in scan(rows, rows[7][2], 500, 1)]
    assert layout.search([0.0] * 12, 3).count() == 3
    assert layout.search(rows[0][2], 10_000).count() == len(rows)


def test_files_read_by_a_search(spark, tmp_path):
    frame, rows = clustered(spark)
    vector_layout.write_cells(frame, str(tmp_path / "v"), cells=40, sample=1000)
    layout = vector_layout.VectorLayout(spark, str(tmp_path / "v"))
    found = layout.search(rows[3][2], 20)
    found.collect()
    scans = [node for node in nodes(found._jdf.queryExecution().executedPlan()) if node.nodeName().startswith("Scan parquet")]
    read = sum(int(s.metrics().apply("numFiles").value()) for s in scans)
    assert 0 < read < len(layout.rows.inputFiles()) / 2


def nodes(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def test_cells_of_few_rows(spark, tmp_path):
    schema = "id long, embedding array<float>"
    for number, rows in enumerate(([], [(1, None)], [(1, [1.0, 2.0])], [(1, [0.0, 0.0]), (2, None)])):
        vector_layout.write_cells(spark.createDataFrame(rows, schema), f"{tmp_path}/{number}")
        assert vector_layout.VectorLayout(spark, f"{tmp_path}/{number}").search([1.0, 1.0], 5).count() == len(rows)


# ---- postings ----


def brute(texts, question):
    """The rank of each text that has all stems of the question."""

    def places(text):
        out = defaultdict(list)
        for at, word in enumerate(re.findall(r"[^\W_]+", (text or "").lower()), 1):
            if word not in stemming.STOP_WORDS:
                out[stemming.stem(word)].append(at)
        return out

    asked = list(places(question))
    out = {}
    for i, text in texts.items():
        own = places(text)
        if not asked or not all(t in own for t in asked):
            continue
        if len(asked) == 1:
            out[i] = sum(0.1 / n**2 for n in range(1, len(own[asked[0]]) + 1)) / 1.64493406685
            continue
        left = 1.0
        for a, b in combinations(asked, 2):
            for p in own[a]:
                for q in own[b]:
                    if 0 < abs(p - q) <= 100:
                        left *= 1 - math.sqrt(0.1 * 0.1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
        out[i] = max(1 - left, 1e-20)
    return {i: round(r, 9) for i, r in out.items()}


TEXTS = {
    1: "The appeal was allowed by the court.", 2: "Courts hear appeals; appealing courts is costly.", 3: "appeal " + "filler " * 120 + "court", 4: "An appellant in court", 5: None, 6: "", 7: "the of and",
    8: "Court! COURT? court... appeal-court", 9: "L'appel à la cour", 10: "appeal " * 40 + "court " * 3,
}


@pytest.mark.parametrize("question", ["appeal", "the courts", "appeals in court", "court appealed costly", "of the", "", "nowhere", "cour appel"])
def test_ranks_against_plain_python(spark, tmp_path, question):
    rows = spark.createDataFrame([(i, 100 + i, t) for i, t in TEXTS.items()], "id long, judgment_id long, body string")
    lexical_index.write_postings(rows, str(tmp_path / "p"))
    index = lexical_index.read_postings(spark, str(tmp_path / "p"))
    found = lexical_index.matching(index, question)
    assert {r.id: r.lexical for r in found.collect()} == pytest.approx(brute(TEXTS, question), abs=2e-9)
    assert all(r.judgment_id == 100 + r.id for r in found.collect())
    terms = stemming.query_terms(question)
    if terms:
        plan = found._jdf.queryExecution().executedPlan().toString()
        pushed = re.search(r"PushedFilters: \[([^\]]*)", plan)[1]
        assert "term" in pushed and all(t in pushed for t in terms)


def test_words_close_together_rank_higher(spark):
    rows = spark.createDataFrame([(1, "appeal a b c d e f g court"), (2, "appeal court"), (3, "appeal x court")], "id long, body string")
    ranks = {r.id: r.lexical for r in lexical_index.matching(lexical_index.postings(rows), "courts appeal").collect()}
    assert ranks[2] > ranks[3] > ranks[1]


needs_tables = pytest.mark.skipif(not Path(DIR).exists(), reason="the driver's tables are not here")


@needs_tables
def test_registered_ranks_and_the_hybrid_search(spark):
    texts = dict(duckdb.sql(f"SELECT vec_id, text FROM '{DIR}/documents.parquet' JOIN '{DIR}/embeddings.parquet' ON doc_id = vec_id").fetchall())
    ranks = brute(texts, indexes.QUESTION)
    order = sorted(ranks, key=lambda i: (-ranks[i], i))[:100]
    got = {r.rank_f: (r.id, r.lexical) for r in QUERIES["stemmed_rank"].plan(spark, DIR).collect()}
    assert got == {n: (i, pytest.approx(ranks[i], abs=2e-9)) for n, i in enumerate(order, 1)} and len(got) > 5

    vector = retrieval.query_vector(spark, DIR)
    vectors = dict(duckdb.sql(f"SELECT vec_id, embedding FROM '{DIR}/embeddings.parquet'").fetchall())
    within = {i for i in texts if 1990 + i % 35 >= 1995}
    near = [i for _, i in scan([(i, 0, [float(x) for x in vectors[i]]) for i in within], vector, 100)]
    lexical = [i for i in sorted(ranks, key=lambda i: (-ranks[i], i)) if i in within][:100]
    scores = {}
    for i in set(near) | set(lexical):
        rank = lambda xs: xs.index(i) + 1 if i in xs else 1000  # noqa: B023, E731
        scores[i] = 0.7 / (60 + rank(near)) + 0.3 / (60 + rank(lexical))
    best = sorted(scores, key=lambda i: (-scores[i], i))[:50]
    final = {i: round(scores[i] + (0.05 if i % 3 == 0 else 0), 9) for i in best}
    wanted = sorted(final, key=lambda i: (-final[i], i))[:20]
    found = QUERIES["hybrid_search_indexed"].plan(spark, DIR).collect()
    assert {r.id: r.score for r in found} == {i: pytest.approx(final[i], abs=2e-9) for i in wanted}


def test_the_exact_scan_agrees(spark):
    frame, rows = clustered(spark, 200)
    far = F.round(cosine_distance(F.col("embedding"), literal(rows[9][2])), 9)
    got = frame.where("embedding IS NOT NULL").select("id", far.alias("d")).orderBy("d", "id").limit(10).collect()
    assert [r.id for r in got] == [i for _, i in scan([r for r in rows if r[2]], rows[9][2], 10)]


def test_postings_are_stemmed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    rows = spark.createDataFrame([(i, f"word{i} bail") for i in range(50)], "id long, body string").select("id", counted("body").alias("body"))
    lexical_index.write_postings(rows, str(tmp_path / "p"))
    assert seen.value == 50 and lexical_index.read_postings(spark, str(tmp_path / "p")).count() == 100
