"""Star schema for dashboards: four dimensions and two facts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftscope.functions.numbers import days_between
from shiftscope.session import dealt
from shiftscope.sources.tables import Shop

# fixed values: first and last day of the calendar dimension
FIRST_DAY, LAST_DAY = date(2016, 1, 1), date(2018, 12, 31)


def dim_date(spark: SparkSession, first: date = FIRST_DAY, last: date = LAST_DAY) -> DataFrame:
    """One row per calendar day."""
    days = F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day")))
    day = F.col("date_key")
    weekday = F.weekday(day) + 1  # ISO: Monday = 1
    return spark.range(1).select(days.alias("date_key")).select(
        day, F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"),
        F.date_format(day, "yyyy-MM").alias("year_month"), weekday.alias("weekday"), (weekday >= 6).alias("is_weekend"),
    )


def dim_customer(shop: Shop) -> DataFrame:
    return shop.customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state")


def dim_seller(shop: Shop) -> DataFrame:
    return shop.sellers.select("seller_id", "seller_city", "seller_state")


def dim_product(shop: Shop) -> DataFrame:
    named = shop.products.join(shop.category_translation, "product_category_name", "left")
    unknown = F.lit("unknown")
    return named.select(
        "product_id", F.coalesce("product_category_name", unknown).alias("category"),
        F.coalesce("product_category_name_english", unknown).alias("category_english"), "product_weight_g", "product_photos_qty",
    )


def is_late() -> "F.Column":
    """1 / 0 for delivered orders with a delivery date, else NULL."""
    done = (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    return F.when(done, late.cast("int"))


def fact_order_items(shop: Shop) -> DataFrame:
    """Item grain. Reviews are averaged per order before the join, so they cannot multiply items."""
    orders = shop.orders.select(
        "order_id", "customer_id", F.to_date("order_purchase_timestamp").alias("purchase_date_key"), "order_status",
        is_late().alias("is_late"), days_between(F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")).alias("delivery_days"),
    )
    reviews = shop.order_reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))
    order_facts = orders.join(reviews, "order_id", "left")
    items = shop.order_items.select("order_id", "order_item_id", "seller_id", "product_id", "price", "freight_value")
    return items.join(order_facts, "order_id").withColumn("item_total", F.col("price") + F.col("freight_value"))


def fact_payments(shop: Shop) -> DataFrame:
    """Payment grain. A large table is dealt by order to tasks of bounded size, where keys that hold the order can be counted at once."""
    orders = shop.orders.select("order_id", "customer_id", F.to_date("order_purchase_timestamp").alias("purchase_date_key"))
    cols = ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"]
    return dealt(shop.order_payments.select(*cols), "order_id").join(orders, "order_id")


def build_mart(shop: Shop, spark: SparkSession) -> dict[str, DataFrame]:
    """All six tables; the calendar spans the days of the orders."""
    bought = F.to_date("order_purchase_timestamp")
    first, last = shop.orders.agg(F.min(bought), F.max(bought)).first()
    return {
        "dim_date": dim_date(spark, first or FIRST_DAY, last or LAST_DAY), "dim_customer": dim_customer(shop), "dim_seller": dim_seller(shop),
        "dim_product": dim_product(shop), "fact_order_items": fact_order_items(shop), "fact_payments": fact_payments(shop),
    }


def save_mart(mart: dict[str, DataFrame], folder: str) -> None:
    """Facts are partitioned by purchase month, so a dashboard filter on dates reads only those months."""
    for name, df in mart.items():
        if name.startswith("fact_"):
            month = F.date_format("purchase_date_key", "yyyy-MM")
            df = df.withColumn("purchase_month", month).hint("rebalance", "purchase_month")
            df.write.mode("overwrite").partitionBy("purchase_month").parquet(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
