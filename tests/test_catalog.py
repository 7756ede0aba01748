"""Every query against its SQL oracle on the smallest tables."""

import pytest
from conftest import same

from cellgraph.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(name, spark, sf, duck):
    got, want = same(catalog.queries()[name](spark, sf), duck.sql(catalog.oracle_sql()[name]))
    assert got == want


def test_entry_module(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
