"""Every registered query with SQL gives the SQL's rows; the others run and have rows."""

import pytest
from compare import of_spark, of_sql

from gradeloom import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert of_spark(plans.QUERIES[name](spark, sf_dir)) == of_sql(sf_dir, plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_has_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
