"""Plan shape guards: no cross products or nested-loop joins anywhere, and no
Python stage outside the stateful streams (whose Python is the state
machine itself)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "scripts"))

from plan_report import summarise  # noqa: E402

from shoplytics.plans.registry import load_all  # noqa: E402
from tests.conftest import SF001  # noqa: E402

REG = load_all()


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.sql))
def test_plan_shape(spark, name):
    df = REG[name].run(spark, SF001)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    s = summarise(plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not s["python"], s["python"]


def test_event_type_filters_reach_the_scan(spark):
    for name in ("toppick_tallies", "basket_contents", "checkout_funnel"):
        df = REG[name].run(spark, SF001)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().toString()
        assert "EqualTo(event_type," in plan, name
