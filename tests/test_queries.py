"""Every catalog query against its SQL, and plans."""

import pytest

import __spark_entry__ as entry
from eventlode.plans import registry
from tests.oracle_check import assert_same, connected

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert_same(registry.queries()[name](spark, SF), duck, registry.oracle_sql()[name])


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan_and_no_product_is_made(spark):
    plan = registry.queries()["q07_source_detail"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan or "PushedFilters: [IsNotNull(o_orderpriority)" in plan
    for name in ("q01_search_page", "p09_type_terms", "q08_daily_pulse", "w04_canonical_venues"):
        assert "CartesianProduct" not in registry.queries()[name](spark, SF)._jdf.queryExecution().toString()
