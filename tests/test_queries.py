"""Each query of the core against its SQL, and the entry points."""

import pytest

from skein.plans import oracles, queries
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), oracles.ORACLES[name], sf_dir) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["host", "category", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
