"""Every catalogue query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from larkspan import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(rows):
    return sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    r = duck.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(n) for n in names]
    assert norm(tuple(x[n] for n in names) for x in df.collect()) == norm(tuple(x[i] for i in at) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
