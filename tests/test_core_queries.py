"""Every registered query of the core package, against its SQL where it has some."""

import pytest
from compare import assert_same

from tidemark import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, name):
    df = catalog.queries()[name](spark, data)
    if name in SQL:
        assert_same(df, SQL[name], data)
    else:
        assert df.count() > 0


def test_entry_points_without_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
