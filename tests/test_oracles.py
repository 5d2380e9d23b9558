"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import oracle
import pytest
from paths import SF, TINY

from terrane import catalog


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert oracle.differences(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, TINY).count() >= 0
