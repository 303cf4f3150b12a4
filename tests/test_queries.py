"""Every query of the core against its SQL, over the whole small tables."""

import pytest

from conftest import same_rows
from loamsift.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, duck, name):
    same_rows(QUERIES[name](spark, small), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["doc_id", "text"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
