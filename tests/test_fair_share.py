"""Shares of a budget: one sort of a key's rows serves all windows."""

import re

from harvestry import registry


def test_rows_are_sorted_once(spark):
    df = registry.queries()["fair_share_budget"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len(re.findall(r"\bSort \[", df._jdf.queryExecution().executedPlan().toString())) == 1, plan
