"""Connected components by min-label steps with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``edges`` (u, v).

    Each step takes the smallest label among neighbours, then that label's own
    label, and writes its table; the number of steps grows with the logarithm
    of a component's diameter. Neither edges nor labels reach the driver.
    """
    # Written once before both directions are read: links made twice could differ, and both directions must agree.
    once = common.saved(edges.where("u <> v").select("u", "v").distinct(), "links")
    both = common.saved(once.union(once.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    held = labels = common.saved(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        moved = common.saved(step.join(jump, "low").select("node", F.least("low", "far").alias("next"), "root"), "labels")
        changed = moved.where("next <> root").limit(1).count()
        common.forget(held)
        held, labels = moved, moved.select("node", F.col("next").alias("root"))
        if not changed:
            common.forget(once, both)
            return labels
