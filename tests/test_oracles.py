"""Every query of the imagery engine that SQL can express gives the rows of its SQL in DuckDB."""

import pytest

from terragrid.plans import catalog
from tests.oracle import DATA, differences


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, name):
    assert differences(spark, catalog.QUERIES[name], catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows_and_repeats_itself(spark, name):
    first = catalog.QUERIES[name](spark, str(DATA)).collect()
    again = catalog.QUERIES[name](spark, str(DATA)).collect()
    assert first and sorted(map(str, first)) == sorted(map(str, again))
