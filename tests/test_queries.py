"""Every query of the engine against the SQL that gives its rows."""

import pytest
from settings import SF

import __spark_entry__ as entry
from tidemark.plans import registry

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, spark, duck, same):
    same(registry.QUERIES[name](spark, SF), duck, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_result_does_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = sorted(map(repr, registry.QUERIES["onset_robust"](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(repr, registry.QUERIES["onset_robust"](spark, SF).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
