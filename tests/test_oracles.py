import pytest

import __spark_entry__
from docsieve.plans import registry

from .oracle import connection, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_against_sql(spark, con, name):
    few_suppliers = name == "jn_same_company"  # no two of the ten here are of one nation
    same(spark, con, FOLDER, registry.QUERIES[name], registry.SQL[name], may_be_empty=few_suppliers)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
