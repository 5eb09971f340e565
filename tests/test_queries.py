import pytest

from corvane import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(name, same_rows):
    same_rows(catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
