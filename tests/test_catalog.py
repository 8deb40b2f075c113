"""Every query runs; those with SQL give the rows that DuckDB gives."""

import pytest
from conftest import DATA, rows

from swatchwork.plans import catalog, layouts, readers, systems, themes  # noqa: F401  they add to the catalogue


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.SQL:
        assert len(got)
        return
    want = duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
