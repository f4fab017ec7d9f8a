import random

import brute
import pytest
from test_operators import ODD, prose

import corpus_pipeline
from docketeer.llm import language

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, score string, fp int"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(1, "the partners must deliver the sealed ledger to the registrar before the ninth day of june")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    leak = items[0][1].replace("ledger", "ledgers").upper()
    r = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(8, ODD[8])]
    rows += [(100 + i, "\n".join(prose(100 * i + k, 30) for k in range(6))) for i in range(12)]
    rows += [(200, rows[-1][1]), (201, f"{prose(900, 40)}\n{leak}\n{prose(901, 40)}"), (202, prose(902, 200)), (None, "one text without an id"), (None, None)]
    words = rows[-3][1].split()
    words[r.randrange(100, 190)] = "another"
    rows.append((203, " ".join(words)))
    full = [(d, t, "en" if i % 7 else None, "web" if i % 5 else None, len(t) if t and i % 3 else None, i, "own", 7) for i, (d, t) in enumerate(rows)]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/nothing.parquet")
    return folder


def by_id(frame):
    return {r.doc_id: r for r in frame.collect() if r.doc_id is not None}


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs, sf_dir)
    assert told.columns == columns and {r.score for r in told.collect()} == {"own"}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in told.collect()} == lettered

    lines = stages["line_dedup"](spark, docs, sf_dir)
    got = by_id(lines)
    assert lines.columns == columns and lines.count() == docs.count() and [r.n_lines for r in lines.collect()].count(None) == 0
    assert got[200].text == "" and got[111].text.count("\n") == 5 and got[202].n_chars == len(got[202].text)

    near = stages["near_dedup"](spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    sets = {d: set(brute.shingles(t, 5)) for d, t in texts.items()}
    alike = brute.groups(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert near.columns == columns and by_id(near).keys() == set(alike.values())
    assert 203 not in by_id(near) and 202 in by_id(near)

    clean = stages["decontaminate"](spark, docs, sf_dir)
    assert clean.columns == columns and by_id(docs).keys() - by_id(clean).keys() == {201}

    packed = stages["pack"](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_on_empty_tables(spark, sf_dir):
    nothing = spark.read.parquet(f"{sf_dir}/nothing.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0


def test_whole_pipeline(spark, sf_dir):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {100, 111, 202} <= ids and not ids & {0, 1, 2, 3, 201}


def test_no_labels_no_rejections_by_language(spark):
    docs = spark.createDataFrame([(1, "a text", None), (2, "123", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]
    assert [r.lang_pred for r in language.identify(docs, language.learn(docs)).collect()] == ["und", "und"]
