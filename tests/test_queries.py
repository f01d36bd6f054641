import pytest

import __spark_entry__
from docindex.oracles import ORACLES
from docindex.queries import QUERIES
from tests.compare import connection, rows_of_frame, rows_of_sql


@pytest.fixture(scope="module")
def duck(data):
    return connection(data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, duck, name):
    assert rows_of_frame(QUERIES[name](spark, data)) == rows_of_sql(duck, ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
