"""Queries that SQL can express, against DuckDB."""

import pytest

from check import compare, duck_rows, spark_rows
from meterlens.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", list(ORACLES))
def test_matches_oracle(spark, duck, key):
    mine = spark_rows(QUERIES[key](spark, SF_DIR))
    assert mine[1]
    assert compare(mine, duck_rows(duck, ORACLES[key])) is None


def test_every_operator_has_a_query():
    assert sorted(int(key[2:].split("_")[0]) for key in QUERIES) == list(range(1, 14))
