"""Every query of the library against its SQL on the small tables; those without SQL must have rows."""

import pytest

from quillspark.plans import registry

from .oracle import connect, oracle_rows, rows_of

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, name):
    got = rows_of(registry.QUERIES[name](spark, DATA))
    if name in registry.SQL:
        assert got == oracle_rows(con, registry.SQL[name])
    assert got[1]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
