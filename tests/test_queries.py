"""Every registered query of the library against its SQL."""

from __future__ import annotations

import compare
import pytest

from newsloom.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


#: Names of one query are run once.
NAMES = sorted({q: name for name, q in sorted(QUERIES.items(), reverse=True)}.values())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, small, name):
    found = QUERIES[name](spark, small)
    if name in SQL:
        assert not compare.differences(found, compare.views(small), SQL[name])
    else:
        raise AssertionError(f"{name} has no SQL: test it here by brute force")


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["rank", "id", "item_type", "title", "agency", "impact", "notice_end", "priority", "total"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
