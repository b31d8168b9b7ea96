"""Positions, running sums and row windows over groups that may be very large.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here the rows are first range-partitioned by group, ordering value and
ties, so a group is cut into slices wherever it is large, whatever the type of the ordering value and however often one value occurs.
Each slice is handled by its own task, and only one small row per slice is combined afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftscope.session import cut_lineage


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    lead: str,
    sums: dict[str, Column],
    ties: Sequence[str] = (),
    parts: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums of each entry of ``sums`` within ``group`` in the order (lead, ties).

    NULLs come first in ascending and last in descending order, as in a window.
    """
    group = list(group)
    key = F.col(lead).desc() if descending else F.col(lead).asc()
    order = [*[F.col(g).asc() for g in group], key, *[F.col(t).asc() for t in ties]]
    valued = df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    # written once: the number of a range partition must be the same wherever it is used
    sliced = cut_lineage(valued.repartitionByRange(_parts(df, parts), *order).withColumn("_slice", F.spark_partition_id()))
    # one row per (group, slice): at most `parts` rows per group reach the small window below
    sizes = sliced.groupBy(*group, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_slice").alias("_s"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    same = F.col("_slice") == F.col("_s")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = Window.partitionBy(*group, "_slice").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.join(offsets, same)
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0)) + F.col(f"_o_{name}"))
    return out.drop("_slice", "_s", *[f"_g_{g}" for g in group], *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def positions(
    df: DataFrame,
    group: Sequence[str],
    lead: str,
    ties: Sequence[str] = (),
    out: str = "pos",
    parts: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Exact 1-based position of every row within its group."""
    return running_sums(df, group, lead, {out: F.lit(1).cast("bigint")}, ties, parts, descending)


def halo_blocks(df: DataFrame, pos: str, before: int, block: int = 4096) -> DataFrame:
    """Cut dense positions (1, 2, ...) into blocks and repeat the last ``before`` rows of a block in the next.

    Adds ``_block`` and ``_halo``. A ROWS window that looks back at most ``before`` rows is then exact inside
    (group, _block); drop the ``_halo`` rows afterwards.
    """
    if before >= block:
        raise ValueError("block must be longer than the look-back")
    index = F.col(pos) - 1
    own = F.floor(index / block)
    places = F.when(
        index % block >= block - before,
        F.array(F.struct(own.alias("b"), F.lit(False).alias("h")), F.struct((own + 1).alias("b"), F.lit(True).alias("h"))),
    ).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("h"))))
    return (
        df.withColumn("_place", F.explode(places))
        .withColumn("_block", F.col("_place.b"))
        .withColumn("_halo", F.col("_place.h"))
        .drop("_place")
    )
