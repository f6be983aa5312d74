"""Every query that has SQL against DuckDB on the driver's tables; every other one runs and gives rows."""

import os

import duckdb
import pytest

from scanweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MADE_UP, MADE_UP_SQL = catalog.unregistered()
QUERIES, SQL = catalog.queries() | MADE_UP, catalog.oracle_sql() | MADE_UP_SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert name in ("dumbbell_pairs", "find_vectors_nxcorr") or len(got)
        return
    want = duck.sql(SQL[name]).df()
    assert set(got.columns) == set(want.columns)
    assert len(got) == len(want)
    cols = sorted(got.columns)
    a, b = (df[cols].sort_values(cols).reset_index(drop=True) for df in (got, want))
    for c in cols:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all() and a[c].dtype.kind == "f":
            same = same | ((a[c] - b[c]).abs() <= 1e-6 * a[c].abs().clip(lower=1))
        assert same.all(), c


def test_what_is_registered():
    assert set(MADE_UP) == catalog.WITHOUT_TABLES and not catalog.WITHOUT_TABLES & set(catalog.queries()) and not catalog.WITHOUT_TABLES & set(catalog.oracle_sql())
