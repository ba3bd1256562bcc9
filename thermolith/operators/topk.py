"""The largest outliers of each tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TOP


def ranked(outliers: DataFrame) -> DataFrame:
    order = Window.partitionBy("batch_id").orderBy(F.desc("deviation"), "y", "x")
    return outliers.withColumn("rank", F.row_number().over(order))


def top_outliers(outliers: DataFrame, n: int = TOP) -> DataFrame:
    """One row per tile with y1, x1, d1 to yn, xn, dn; null where a tile has fewer. The rank limit runs before the exchange too."""
    top = ranked(outliers).where(F.col("rank") <= n)
    return top.groupBy("batch_id").agg(*(F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{a}{i}") for i in range(1, n + 1) for a, c in (("y", "y"), ("x", "x"), ("d", "deviation"))))
