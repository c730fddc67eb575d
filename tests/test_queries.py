import pytest

from folio.plans import registry
from tests.oracle import connect, rows_of_spark, rows_of_sql

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    columns, rows = rows_of_spark(registry.queries()[name](spark, sf_dir))
    assert rows
    if name in ORACLES:
        assert (columns, rows) == rows_of_sql(con, ORACLES[name])
