"""Every registered core query against its SQL, or that it runs."""

import pytest

import __spark_entry__
from twinweave import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_agrees(name, same_rows):
    same_rows(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert registry.FLAGSHIP in __spark_entry__.queries()
