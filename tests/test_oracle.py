"""Every query against its SQL on the smallest tables."""

import pytest

from verification import oracle, queries
from verification.compare import database, difference

SF = "/root/testdata/sf0.001"
KNOWN, SQL = queries.build(), oracle.build()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", KNOWN)
def test_query(spark, con, name):
    df = KNOWN[name](spark, SF)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(KNOWN)


def test_trusted_keys_change_nothing(spark):
    from bazaar.sources.star import load_sales

    columns = ("city", "category", "monthly_sales")
    pruned = load_sales(spark, SF, *columns, trusted_keys=True)
    joined = load_sales(spark, SF, *columns)
    assert pruned.exceptAll(joined).isEmpty() and joined.exceptAll(pruned).isEmpty()
