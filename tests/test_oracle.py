"""Every registered query against its SQL, and its plan against what must not be in it."""

import os

import pytest

import compare
from headwater.catalog import ORACLES, QUERIES

FOLDER = f"{compare.ROOT}/{os.environ.get('HEADWATER_TEST_SF', 'sf0.001')}"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def connection():
    pytest.importorskip("duckdb")
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    built = QUERIES[name](spark, FOLDER)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in ORACLES:
        assert compare.compare(spark, connection, FOLDER, lambda *_: built, ORACLES[name]) is None
    else:
        assert built.limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
