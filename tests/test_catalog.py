"""Every registered query against its SQL twin at the smallest scale."""

import pytest

from catalog import compare
from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from conftest import SMALLEST


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SMALLEST)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_twin(spark, connection, name):
    assert compare.differences(QUERIES[name](spark, SMALLEST), connection, ORACLE[name]) == []


def test_only_tree_models_have_no_twin():
    assert {n for n in QUERIES if n not in ORACLE} == {"boosted_demand_quality", "boosted_product_evaluation"}
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.queries()) >= set(QUERIES)
