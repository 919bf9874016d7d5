"""The stage queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from siftline.plans import catalog, catalog_stages, catalog_text  # noqa: F401
from tests.test_catalog import DATA, db, rows  # noqa: F401

NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ in ("siftline.plans.catalog_stages", "siftline.plans.catalog_text")]


@pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, db, name):  # noqa: F811
    got = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    if name not in catalog.SQL:
        assert len(got)
        return
    want = db.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)
