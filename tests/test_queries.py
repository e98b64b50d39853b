"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import pytest
from compare import compare

from weftline import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, data, name):
    good, said = compare(spark, data, catalog.QUERIES[name], catalog.ORACLE[name])
    assert good, said


def test_all_queries_run(spark, data):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE):
        assert catalog.QUERIES[name](spark, data).columns
