"""Every registered query against its SQL; those without SQL run and have tests of their own."""

import pytest

from millrace.plans import catalogue
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, spark, same_rows):
    same_rows(catalogue.QUERIES[name](spark, SMALL), catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(name, spark):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["line", "cnt", "saving", "idx"]
