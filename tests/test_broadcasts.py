"""Joins are broadcast by what a side holds when it runs, not by the size of the files it was derived from."""

import pytest

from levelgrid.queries import QUERIES
from levelgrid.session import MEASURED_BYTES, bound_broadcasts

SF = "/root/testdata/sf0.001"
BOUNDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture
def session(spark):
    """The shared session with Spark's own bounds, as they were again afterwards."""
    before = {c: spark.conf.get(c, None) for c in BOUNDS}
    for c in BOUNDS:
        spark.conf.unset(c)
    yield spark
    for c, v in before.items():
        spark.conf.unset(c) if v is None else spark.conf.set(c, v)


@pytest.mark.parametrize("name", ["away_from_walls", "opening_rect", "net_wall_area"])
def test_no_broadcast_by_estimate(session, name):
    plan = QUERIES[name](session, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("given, kept", [("64k", 64 << 10), ("-1", -1), ("1g", MEASURED_BYTES)])
def test_lower_bound_of_the_session_stays(session, given, kept):
    session.conf.set(BOUNDS[0], given)
    for _ in range(2):
        bound_broadcasts(session)
        assert int(session.conf.get(BOUNDS[1])) == kept
