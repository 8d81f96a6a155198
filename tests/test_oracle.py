"""Every checked query against its SQL on the smallest tables."""

import pytest

from furrow.checks import contract

SF = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    import oracle

    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    import oracle

    if name in SQL:
        oracle.compare(spark, con, SF, name, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
