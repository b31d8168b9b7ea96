"""Bear / base / bull projection of many segments at once, in closed form."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window, functions as F

from shiftscope.functions.numbers import ratio


@dataclass(frozen=True)
class Scenario:
    name: str
    order_growth: float
    aov_growth: float
    take_rate: float
    payment_cost: float
    new_customer_share: float
    cac: float
    fixed_cost: float
    fixed_growth: float
    cash: float


# fixed values: the three default scenarios and the horizon in months
SCENARIOS = (
    Scenario("bear", 0.01, 0.000, 0.10, 0.025, 0.97, 45, 450_000, 0.02, 15_000_000),
    Scenario("base", 0.03, 0.002, 0.12, 0.022, 0.95, 35, 420_000, 0.015, 15_000_000),
    Scenario("bull", 0.05, 0.004, 0.14, 0.020, 0.92, 28, 400_000, 0.01, 15_000_000),
)
MONTHS = 36


def project_scenarios(start: DataFrame, key: str, scenarios: tuple[Scenario, ...] = SCENARIOS, months: int = MONTHS) -> DataFrame:
    """Monthly projection per segment and scenario from (key, start_orders, start_aov).

    The scenarios and months are constants unfolded inside each row, so no join is needed. Orders and order
    value grow from the first month on; fixed cost starts growing in the second.
    """
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in asdict(s).items()]) for s in scenarios])
    rows = start.select(key, "start_orders", "start_aov", F.inline(table)).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(months))))
    m = F.col("month").cast("double")
    orders = F.col("start_orders") * F.pow(1 + F.col("order_growth"), m)
    aov = F.col("start_aov") * F.pow(1 + F.col("aov_growth"), m)
    rows = rows.withColumns({"orders": orders, "aov": aov}).withColumn("gmv", F.col("orders") * F.col("aov"))
    rows = rows.withColumns(
        {
            "net_revenue": F.col("gmv") * F.col("take_rate"),
            "payment_costs": F.col("gmv") * F.col("payment_cost"),
            "new_customers": F.col("orders") * F.col("new_customer_share"),
        }
    ).withColumn("marketing", F.col("new_customers") * F.col("cac"))
    rows = rows.withColumns(
        {
            "contribution": F.col("net_revenue") - F.col("payment_costs") - F.col("marketing"),
            "fixed_costs": F.col("fixed_cost") * F.pow(1 + F.col("fixed_growth"), m - 1),
        }
    ).withColumn("ebitda", F.col("contribution") - F.col("fixed_costs"))
    # at most `months` rows per window
    running = Window.partitionBy(key, "name").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cash_end", F.col("cash") + F.sum("ebitda").over(running))
    return rows.select(
        key, F.col("name").alias("scenario"), "month", "orders", "aov", "gmv", "net_revenue", "payment_costs", "new_customers",
        "marketing", "contribution", "fixed_costs", "ebitda", "cash_end",
    )


def scenario_summary(projection: DataFrame, key: str, months: int = MONTHS) -> DataFrame:
    """Headline numbers per segment and scenario."""
    at = lambda col, m: F.max(F.when(F.col("month") == m, F.col(col)))
    return projection.groupBy(key, "scenario").agg(
        at("gmv", 12).alias("gmv_month_12"), at("gmv", months).alias("gmv_last_month"),
        ratio(at("contribution", 12), at("net_revenue", 12)).alias("contribution_margin_month_12"),
        F.min(F.when(F.col("ebitda") > 0, F.col("month"))).alias("first_positive_month"),
        F.min("cash_end").alias("lowest_cash"), F.count_if(F.col("cash_end") > 0).alias("months_with_cash"),
    )
