"""Scale guards on the physical plans of every registered batch query.

No nested-loop or cartesian join, no row-at-a-time Python, no exchange that
moves all rows into one partition (a global sort uses range partitioning;
top-k uses per-partition limits). A single-partition exchange is allowed only
directly above a partial aggregate -- it then carries one row per partition.
"""

import pytest

import __spark_entry__ as E
from faultline.plans import QUERIES

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython"]


def unbounded_single_partition(plan: str) -> bool:
    lines = [ln for ln in plan.splitlines() if ln.strip()]
    for i, ln in enumerate(lines):
        if "Exchange SinglePartition" in ln:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            if not ("HashAggregate" in below and "partial_" in below):
                return True
    return False
BATCH = sorted(n for n in QUERIES if not n.endswith("_stream") and not n.endswith("_stream_evicting"))


@pytest.mark.parametrize("name", BATCH)
def test_plan_has_no_unscalable_nodes(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = E.queries()[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    bad = [m for m in FORBIDDEN if m in plan]
    assert not bad, f"{name}: {bad}"
    assert not unbounded_single_partition(plan), f"{name}: all rows through one partition"
