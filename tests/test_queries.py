"""Every registered query of the reference's operators against its SQL."""

from __future__ import annotations

import pytest
from compare import differences

from tidemark.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, small, name):
    assert not differences(QUERIES[name](spark, small), SQL[name], small)


def test_every_query_runs(spark, small):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, small).columns


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
