"""op4: nothing that grows with the documents goes through the driver."""

from harvestry.llm import simhash


def test_joins_of_fingerprints_are_not_broadcast(spark):
    """Small files once let Spark broadcast them, and the many cells made of them."""
    nodes = spark.range(100).selectExpr("id * 7919 as fp")
    for pairs in (simhash.links(nodes), simhash.hub_links(nodes)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
