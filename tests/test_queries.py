"""Every registered query against its SQL, and the shape of its plan."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from scorebook.plans.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    line = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert line.startswith("ok") and "TYPES" not in line, line


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["perspective_to_neutral", "unresolved_names", "upsert", "geofence_match", "game_window_match",
                                  "favorite_notifications", "schedule_with_live_by_team", "self_not_exists", "source_records"])
def test_no_all_pairs_joins(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
