"""Dashboard measures over the star schema, each for any set of grouping columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftscope.functions.numbers import month_of, ratio


SKETCH_BITS = 14  # 2**14 registers: a standard error under 1 %


def orders_measure(approximate: bool = False) -> Column:
    """Distinct orders; the approximate form keeps one fixed-size sketch per group."""
    return F.approx_count_distinct("order_id") if approximate else F.count_distinct("order_id")


def order_sketches(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, sketch): the distinct orders of each group as a HyperLogLog sketch of some kilobytes. Sketches can be stored and merged."""
    return items.groupBy(*by).agg(F.hll_sketch_agg("order_id", SKETCH_BITS).alias("sketch"))


def sketched_orders(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, orders): estimated distinct orders of any union of groups, without another look at the items."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("orders"))


def item_measures(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Orders, item revenue, average order value, freight share, late rate and review score.

    Rows are first reduced to one per order and group (map-side combine), so every distinct count is a plain count.
    """
    per_order = items.groupBy(*by, "order_id").agg(
        F.sum("price").alias("price"), F.sum("freight_value").alias("freight"), F.sum("item_total").alias("item_total"),
        F.max("is_late").alias("is_late"), F.sum("review_score").alias("score_sum"), F.count("review_score").alias("score_n"),
    )
    return per_order.groupBy(*by).agg(
        F.count("*").alias("orders"), F.sum("price").alias("item_revenue"),
        ratio(F.sum("item_total"), F.count("*")).alias("average_order_value"),
        ratio(F.sum("freight"), F.sum("item_total")).alias("freight_share"),
        ratio(F.count_if(F.col("is_late") == 1), F.count("is_late")).alias("late_rate"),
        ratio(F.sum("score_sum"), F.sum("score_n")).alias("avg_review_score"),
    )


def gmv(payments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return payments.groupBy(*by).agg(F.sum("payment_value").alias("gmv"))


def monthly(df: DataFrame) -> DataFrame:
    return df.withColumn("month", month_of(F.col("purchase_date_key")))


def month_over_month(monthly_values: DataFrame, value: str) -> DataFrame:
    """Change against the calendar month before; NULL when that month has no row."""
    previous = monthly_values.select(F.add_months("month", 1).alias("month"), F.col(value).alias("previous"))
    joined = monthly_values.join(previous, "month", "left")
    return joined.withColumn("change", ratio(F.col(value) - F.col("previous"), F.col("previous")))


def year_to_date(monthly_values: DataFrame, value: str, out: str) -> DataFrame:
    """Running total inside each calendar year (at most 12 rows per window)."""
    window = Window.partitionBy(F.year("month")).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return monthly_values.withColumn(out, F.sum(value).over(window))


def repeated_payment_rows(payments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows minus distinct (order, sequence) keys."""
    per_key = payments.groupBy(*by, "order_id", "payment_sequential").agg(F.count("*").alias("n"))
    return per_key.groupBy(*by).agg((F.sum("n") - F.count("*")).alias("repeated_rows"))


def order_rates(orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cancellation rate over all orders and mean delivery days over delivered ones."""
    canceled = F.when(F.col("order_status") == "canceled", 1).otherwise(0)
    return orders.groupBy(*by).agg(F.avg(canceled).alias("cancellation_rate"), F.avg("delivery_days").alias("avg_delivery_days"))


def late_rate_by(items: DataFrame, dimension: DataFrame, key: str, label: str) -> DataFrame:
    """Late rate per label of a dimension; an order counts once per label."""
    rows = items.where(F.col("is_late").isNotNull()).join(dimension.select(key, label), key)
    per_order = rows.groupBy(label, "order_id").agg(F.max("is_late").alias("is_late"))
    return per_order.groupBy(label).agg(F.avg("is_late").alias("late_rate"), F.count("*").alias("orders"))


def delivery_days_histogram(orders: DataFrame, width: float = 5.0, buckets: int = 10) -> DataFrame:
    """Orders per delivery-time bucket; the last bucket is open."""
    bucket = F.least(F.floor(F.col("delivery_days") / width), F.lit(buckets - 1)).cast("int")
    return orders.where(F.col("delivery_days").isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("orders"))
