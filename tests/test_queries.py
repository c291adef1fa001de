"""Every query with SQL gives the SQL's rows on the small tables; the others run."""
import pytest
from harness import connect, difference

from folioscan.plans import queries as Q
from folioscan.plans import structure  # noqa: F401 - registers its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    if name in Q.SQL:
        assert difference(spark, con, Q.QUERIES[name], Q.SQL[name], SF) is None
    else:
        assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
