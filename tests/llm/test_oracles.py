"""Registered training-data queries against their SQL."""

import pytest

from eventlode.llm import registry
from tests.oracle_check import assert_same, connected

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF), connected(SF), registry.oracle_sql()[name])


def test_one_query_for_each_operator():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names if n != "pipeline"] == [f"op{i}" for i in range(1, 14)] and "pipeline" in names
