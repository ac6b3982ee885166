"""Step runs over items, set at a time: what each step's outcome leaves behind, and where the clock stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run(rows: DataFrame, item: str) -> DataFrame:
    """(item, value, problems, outcomes) of rows(item, step, outcome, value): the last value of a step that didn't fail, and all problems in order.

    A failed step rolls back to the value before it; its problem stays. An item all of whose steps failed has no value.
    """
    bad = F.col("outcome") != "succeeded"
    told = F.array_sort(F.collect_list(F.when(bad, F.struct("step", "outcome"))))
    kept = F.max_by("value", F.when(F.col("outcome") != "failed", F.col("step")))
    return rows.groupBy(item).agg(kept.alias("value"), F.count_if(bad).alias("problems"), F.array_join(F.transform(told, lambda x: x["outcome"]), ",").alias("outcomes"))


def cutoff(rows: DataFrame, item: str, order: list[str], cost: str, limit: float) -> DataFrame:
    """Rows that start before an item's costs reach the limit, with state `run`, and the first one past it, marked; later ones go."""
    before = Window.partitionBy(item).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(before), F.lit(0))
    marked = rows.withColumn("_late", spent >= limit)
    earlier = F.coalesce(F.max("_late").over(before), F.lit(False))
    return marked.withColumn("_past", earlier).where(~F.col("_past")).withColumn("state", F.when(F.col("_late"), "wall-clock-exceeded").otherwise("run")).drop("_late", "_past")
