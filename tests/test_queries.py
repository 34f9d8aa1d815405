"""Every query of the library against its SQL."""

import pytest

from presslens import catalog
from tests.conftest import same_rows

SLOW: set[str] = set()


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in catalog.oracle_sql()])
def test_matches_sql(name, spark, sf, duck):
    same_rows(catalog.queries()[name](spark, sf), duck, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql() and n not in SLOW])
def test_runs(name, spark, sf):
    assert catalog.queries()[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
