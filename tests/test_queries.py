import pytest

from provena.plans.all import ORACLE, QUERIES

from .parity import differences, oracle

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_what_its_sql_gives(spark, db, name):
    assert differences(spark, db, QUERIES[name], ORACLE[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
