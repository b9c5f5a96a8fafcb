import pytest

from zonewright.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(name, agrees):
    agrees(catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
