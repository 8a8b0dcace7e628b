import pytest
from oracle import same

from strandloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query_equals_its_sql(spark, data, name):
    same(spark, data, catalogue.queries()[name], catalogue.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracles())))
def test_query_without_sql_runs(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
