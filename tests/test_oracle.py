"""Every registered query against its DuckDB statement."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from fixtures.cases import QUERIES as OWN
from check import compare, duck_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"

# queries of optional parts have their tests beside them
QUERIES, ORACLES = ({key: x for key, x in every.items() if key in OWN} for every in (queries(), oracle_sql()))


@pytest.mark.parametrize("key", list(QUERIES))
def test_matches_oracle(spark, duck, key):
    mine = spark_rows(QUERIES[key](spark, SF_DIR))
    assert mine[1], "a fixture must give rows"
    assert compare(mine, duck_rows(duck, ORACLES[key])) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["day", "query_count", "active_users"]
    assert df.count() == 20
