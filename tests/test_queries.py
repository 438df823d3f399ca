"""Every registered query of the base library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from vozlens import plans

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool | str):
        return str(v)
    return f"{float(v):.7g}" if abs(float(v)) < 1e6 else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, D)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    if name not in plans.ORACLE_SQL:
        assert got
        return
    want = db.sql(plans.ORACLE_SQL[name])
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_names():
    assert plans.FLAGSHIP in plans.QUERIES and set(plans.ORACLE_SQL) <= set(plans.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["birth_state", "region", "n_speakers", "n_segments", "hours"]
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
