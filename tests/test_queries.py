"""Every registered query of the library against its SQL."""

import pytest

from compare import rows_of, rows_of_sql
from lodestack.plans import oracles, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    got = rows_of(queries.QUERIES[name](spark, sf_dir))
    assert got == rows_of_sql(oracles.ORACLES[name], sf_dir)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 6
