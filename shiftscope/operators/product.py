"""Product analytics: funnel, cohorts, growth accounting, unit economics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from shiftscope.functions.numbers import month_of, months_between, ratio
from shiftscope.sources.tables import Shop

# fixed values: order states that do not count as activity, and the reported months [first, last)
INACTIVE = ("canceled", "unavailable")
FUNNEL_STEPS = ("purchased", "approved", "shipped", "delivered", "delivered_and_reviewed")


def funnel(shop: Shop) -> DataFrame:
    """Orders reaching each step, with conversion from the start and from the step before."""
    reviewed = shop.order_reviews.select("order_id").distinct().withColumn("reviewed", F.lit(True))
    rows = shop.orders.join(reviewed, "order_id", "left")
    counts = rows.agg(
        F.count("*").alias("purchased"), F.count("order_approved_at").alias("approved"),
        F.count("order_delivered_carrier_date").alias("shipped"), F.count("order_delivered_customer_date").alias("delivered"),
        F.count_if(F.col("order_delivered_customer_date").isNotNull() & F.col("reviewed")).alias("delivered_and_reviewed"),
    )
    steps = []
    for i, step in enumerate(FUNNEL_STEPS):
        before = FUNNEL_STEPS[max(i - 1, 0)]
        steps.append(
            F.struct(
                F.lit(i + 1).alias("step_no"), F.lit(step).alias("step"), F.col(step).alias("orders"),
                ratio(F.col(step), F.col(FUNNEL_STEPS[0])).alias("conversion_from_start"),
                (ratio(F.col(step), F.col(before)) if i else F.lit(1.0)).alias("conversion_from_previous"),
            )
        )
    return counts.select(F.inline(F.array(*steps)))


def active_months(shop: Shop) -> DataFrame:
    """Distinct (person, month) with at least one counted order."""
    orders = shop.orders.where(~F.col("order_status").isin(*INACTIVE))
    people = shop.customers.select("customer_id", F.col("customer_unique_id").alias("person"))
    joined = orders.select("customer_id", month_of(F.col("order_purchase_timestamp")).alias("month")).join(people, "customer_id")
    return joined.select("person", "month").dropDuplicates()


def cohort_counts(active: DataFrame, first: date, last: date) -> DataFrame:
    """(cohort, months_since_first, customers) for cohorts in [first, last)."""
    # a person has at most one row per month here, so this window stays small for everybody
    start = F.min("month").over(Window.partitionBy("person"))
    rows = active.withColumn("cohort", start).where((F.col("cohort") >= F.lit(first)) & (F.col("cohort") < F.lit(last)))
    offset = months_between(F.col("month"), F.col("cohort")).alias("months_since_first")
    return rows.groupBy("cohort", offset).agg(F.count("*").alias("customers"))


def cohort_retention(counts: DataFrame) -> DataFrame:
    """Long form of the retention matrix: customers / cohort size, rounded to 4 digits."""
    size = counts.where(F.col("months_since_first") == 0).select("cohort", F.col("customers").alias("size"))
    return counts.join(size, "cohort").select(
        "cohort", "months_since_first", F.round(ratio(F.col("customers"), F.col("size")), 4).alias("retention")
    )


def cohort_matrix(counts: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Wide form with one column per offset (m0, m1, ...), gaps as 0."""
    long = cohort_retention(counts)
    wide = long.groupBy("cohort").pivot("months_since_first", list(offsets)).agg(F.first("retention"))
    return wide.select("cohort", *[F.coalesce(F.col(str(o)), F.lit(0.0)).alias(f"m{o}") for o in offsets])


def growth_accounting(active: DataFrame, first: date, last: date) -> DataFrame:
    """New, retained, resurrected and churned people per month in [first, last)."""
    person = Window.partitionBy("person").orderBy("month")
    flagged = active.select(
        "person", "month", F.lag("month").over(person).alias("before"), F.lead("month").over(person).alias("after")
    )
    next_month = F.add_months("month", 1)
    # one pass emits the activity of this month and, if the person is gone next month, a churn row dated there
    kind = (
        F.when(F.col("before").isNull(), "new").when(F.col("before") == F.add_months("month", -1), "retained").otherwise("resurrected")
    )
    gone = F.col("after").isNull() | (F.col("after") != next_month)
    marks = F.array(
        F.struct(F.col("month").alias("m"), kind.alias("k")), F.struct(next_month.alias("m"), F.when(gone, "churned").alias("k"))
    )
    rows = flagged.select(F.inline(marks)).where(F.col("k").isNotNull())
    counts = rows.groupBy(F.col("m").alias("month")).agg(
        *[F.count_if(F.col("k") == k).alias(k) for k in ("new", "retained", "resurrected", "churned")]
    )
    # churn dated in a month nobody was active has no row of its own
    live = (F.col("new") + F.col("retained") + F.col("resurrected")) > 0
    return counts.where(live & (F.col("month") >= F.lit(first)) & (F.col("month") < F.lit(last)))


def quick_ratio(growth: DataFrame) -> DataFrame:
    """(new + resurrected) / churned, NULL without churn."""
    return growth.withColumn("quick_ratio", F.round(ratio(F.col("new") + F.col("resurrected"), F.col("churned")), 3))


def unit_economics(shop: Shop, first: date, last: date) -> DataFrame:
    """Per month: orders, item revenue, average order value, freight share."""
    orders = shop.orders.where(~F.col("order_status").isin(*INACTIVE)).select(
        "order_id", month_of(F.col("order_purchase_timestamp")).alias("month")
    ).where((F.col("month") >= F.lit(first)) & (F.col("month") < F.lit(last)))
    per_order = shop.order_items.groupBy("order_id").agg(F.sum("price").alias("items"), F.sum("freight_value").alias("freight"))
    return orders.join(per_order, "order_id").groupBy("month").agg(
        F.count("*").alias("orders"), F.round(F.sum("items"), 2).alias("item_revenue"),
        F.round(F.avg(F.col("items") + F.col("freight")), 2).alias("avg_order_value"),
        F.round(ratio(F.sum("freight"), F.sum(F.col("items") + F.col("freight"))), 4).alias("freight_share"),
    )
