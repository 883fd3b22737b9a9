"""Every query with SQL equals DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from prismata import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(_plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([_plain(r[c]) for c in cols]) for r in df.collect())
    cur = db.execute(registry.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(str([_plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
