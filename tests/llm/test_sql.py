"""The text queries against their SQL, on tables that are not the smallest."""

import pytest

from paigham.llm import queries
from tests.test_queries import rows, tables  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, tables, name):  # noqa: F811
    got = queries.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(tables.execute(queries.oracle_sql()[name]).df())


def test_every_query_is_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries())
