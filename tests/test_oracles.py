import pytest

from mixweave.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs_alike_twice(name, spark, sf_dir):
    first = sorted(map(str, QUERIES[name](spark, sf_dir).collect()))
    assert first and first == sorted(map(str, QUERIES[name](spark, sf_dir).collect()))


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
