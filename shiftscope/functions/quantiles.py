"""Exact quantiles without gathering the values in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from shiftscope.functions.ordered import running_sums
from shiftscope.session import cut_lineage


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Linear-interpolation quantile of a numeric column, from running counts of its distinct values."""
    counts = cut_lineage(df.select(F.col(col).alias("x")).where(F.col("x").isNotNull()).groupBy("x").agg(F.count("*").alias("c")))
    n = counts.agg(F.sum("c")).first()[0]
    if not n:
        return None
    target = (n - 1) * q
    low, high = math.floor(target), math.ceil(target)
    pick = running_sums(counts, [], "x", {"upto": F.col("c")}).agg(
        F.min(F.when(F.col("upto") > low, F.col("x"))).alias("a"),
        F.min(F.when(F.col("upto") > high, F.col("x"))).alias("b"),
    ).first()
    return float(pick["a"]) + (float(pick["b"]) - float(pick["a"])) * (target - low)
