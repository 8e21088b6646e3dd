"""Every named query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from sextant import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(table):
    cols = sorted(table.column_names)
    plain = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in table.to_pylist()), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    mine = rows(catalogue.queries()[name](spark, SF).toArrow())
    theirs = duck.sql(catalogue.oracle_sql()[name]).to_arrow_table()
    assert mine == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF.replace("0.001", "0.01")).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
