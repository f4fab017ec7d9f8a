"""Every registered query with SQL beside it gives the same rows in DuckDB on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from docketeer.plans import QUERIES, flows

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 7) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    query = QUERIES[name]
    df = query.plan(spark, DIR)
    names = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    if query.sql is None:
        assert rows or name == "region_pack"
        return
    wanted = db.sql(query.sql)
    assert sorted(wanted.columns) == names
    assert rows == sorted(repr([plain(r[wanted.columns.index(c)]) for c in names]) for r in wanted.fetchall())


def test_every_query_names_its_operators():
    assert all(q.operators for q in QUERIES.values())


def test_embeddings_are_of_whole_texts(spark):
    texts = ["word " * 100 + end for end in ("alpha", "omega")]
    assert len({tuple(r.v) for r in flows.embedded(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}) == 2
