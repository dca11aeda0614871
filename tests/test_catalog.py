import pytest
from util import SF, duck, rows_of

from lodestone import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, name):
    got = rows_of(catalog.QUERIES[name](spark, SF))
    want = duck(catalog.ORACLE_SQL[name])
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["hotspots", "git_log", "recall", "note_slugs"])
def test_no_window_over_all_rows(spark, name):
    """What is numbered in one place are counts of ranges, never the rows of a table."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" not in plan
