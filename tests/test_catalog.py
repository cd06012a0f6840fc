"""Every registered query of the engine against its SQL, on the small tables."""

import pytest

from tessera.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, smoke_dir):
    made = QUERIES[name](spark, smoke_dir)
    assert made.columns
    made.write.format("noop").mode("overwrite").save()  # every row and column is computed


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
