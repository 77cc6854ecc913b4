"""Queries of the operators that SQL can express, and the pipeline's shape."""

import pytest
from settings import SF

from tidemark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
