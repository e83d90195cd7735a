"""Every registered query against its SQL oracle, or at least to completion."""

import pytest
from check_oracle import difference, oracle_connection

import __spark_entry__ as spark_entry

QUERIES = spark_entry.queries()
ORACLE = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    con = oracle_connection(sf_dir)
    yield con
    con.close()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, connection, name):
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = connection.execute(ORACLE[name]).df()
    assert len(theirs) > 0
    assert difference(ours, theirs) is None
    spark.catalog.clearCache()


# training queries are covered by tests/test_models.py
@pytest.mark.parametrize("name", ["drift_p_values", "design_matrix"])
def test_other_queries_return_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_returns_rows(spark):
    report = spark_entry.entry(spark)
    assert report.columns == ["row", "precision", "recall", "f1", "support"]
    assert report.count() == 5
