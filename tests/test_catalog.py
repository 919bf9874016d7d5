"""Every catalog query against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from siftline.plans.catalog import QUERIES, SQL

NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ == "siftline.plans.catalog")

DATA = Path("/root/testdata/sf0.001")


def rows(df):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "none"
        return round(float(x), 7) if isinstance(x, float) else x if isinstance(x, str) else int(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, db, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
