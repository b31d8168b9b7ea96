"""Thirty everyday questions about the shop, each as one DataFrame expression."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from shiftscope.functions.numbers import days_between, month_of
from shiftscope.sources.tables import Shop

QUESTIONS: dict[str, Callable[[Shop], DataFrame]] = {}


def _question(name: str):
    def register(fn):
        QUESTIONS[name] = fn
        return fn

    return register


def _n(df: DataFrame, out: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(out))


def _top(df: DataFrame, label: str, value: Column, k: int, out: str = "value") -> DataFrame:
    """The k labels with the largest aggregate; equal values in label order."""
    return df.groupBy(label).agg(value.alias(out)).orderBy(F.col(out).desc(), label).limit(k)


def _delivered(orders: DataFrame) -> DataFrame:
    return orders.where((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull())


def _is_late() -> Column:
    return F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")


def _bought(orders: DataFrame, start: date, end: date) -> DataFrame:
    at = F.col("order_purchase_timestamp")
    return orders.where((at >= F.lit(start)) & (at < F.lit(end)))


@_question("I01_order_count")
def _(s):
    return _n(s.orders)


@_question("I02_people")
def _(s):
    return s.customers.agg(F.count_distinct("customer_unique_id").alias("n"))


@_question("I03_seller_count")
def _(s):
    return _n(s.sellers)


@_question("I04_delivered_count")
def _(s):
    return _n(s.orders.where(F.col("order_status") == "delivered"))


@_question("I05_orders_by_status")
def _(s):
    return s.orders.groupBy("order_status").agg(F.count("*").alias("n"))


@_question("I06_total_payments")
def _(s):
    return s.order_payments.agg(F.sum("payment_value").alias("value"))


@_question("I07_mean_review")
def _(s):
    return s.order_reviews.agg(F.avg("review_score").alias("value"))


@_question("I08_largest_customer_state")
def _(s):
    return _top(s.customers, "customer_state", F.count("*"), 1).select("customer_state")


@_question("I09_top_categories")
def _(s):
    rows = s.order_items.join(s.products, "product_id")
    return _top(rows, "product_category_name", F.count("*"), 5, "n")


@_question("I09_top_categories_english")
def _(s):
    rows = s.order_items.join(s.products, "product_id").join(s.category_translation, "product_category_name")
    return _top(rows, "product_category_name_english", F.count("*"), 5, "n")


@_question("I10_commonest_payment_type")
def _(s):
    return _top(s.order_payments, "payment_type", F.count("*"), 1).select("payment_type")


@_question("I11_orders_in_november")
def _(s):
    return _n(_bought(s.orders, date(1997, 11, 1), date(1997, 12, 1)))


@_question("I12_orders_per_month")
def _(s):
    orders = _bought(s.orders, date(1997, 1, 1), date(1998, 1, 1))
    return orders.groupBy(month_of(F.col("order_purchase_timestamp")).alias("month")).agg(F.count("*").alias("n"))


@_question("I13_mean_freight")
def _(s):
    return s.order_items.agg(F.avg("freight_value").alias("value"))


@_question("I14_mean_delivery_days")
def _(s):
    days = days_between(F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date"))
    return _delivered(s.orders).agg(F.avg(days).alias("value"))


@_question("I15_late_percentage")
def _(s):
    return _delivered(s.orders).agg((F.avg(F.when(_is_late(), 1).otherwise(0)) * 100).alias("value"))


@_question("I16_best_seller")
def _(s):
    return _top(s.order_items, "seller_id", F.sum("price"), 1).select("seller_id")


@_question("I17_canceled_count")
def _(s):
    return _n(s.orders.where(F.col("order_status") == "canceled"))


@_question("I18_mean_installments")
def _(s):
    return s.order_payments.where(F.col("payment_type") == "credit_card").agg(F.avg("payment_installments").alias("value"))


@_question("I19_products_without_category")
def _(s):
    return _n(s.products.where(F.col("product_category_name").isNull()))


@_question("I20_top_states_by_payment")
def _(s):
    paid = s.order_payments.join(s.orders.select("order_id", "customer_id"), "order_id").join(s.customers, "customer_id")
    return _top(paid, "customer_state", F.sum("payment_value"), 3)


@_question("I21_payment_per_order")
def _(s):
    per_order = s.order_payments.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    return per_order.agg((F.sum("paid") / F.count("*")).alias("value"))


@_question("I22_five_star_percentage")
def _(s):
    return s.order_reviews.agg((F.avg(F.when(F.col("review_score") == 5, 1).otherwise(0)) * 100).alias("value"))


@_question("I23_seller_cities")
def _(s):
    return s.sellers.agg(F.count_distinct("seller_city").alias("n"))


@_question("I24_busiest_month")
def _(s):
    months = s.orders.select(month_of(F.col("order_purchase_timestamp")).alias("month"))
    return _top(months, "month", F.count("*"), 1).select("month")


@_question("I25_mean_price_in_category")
def _(s):
    wanted = s.products.where(F.col("product_category_name") == "Brand#17").select("product_id")
    return s.order_items.join(wanted, "product_id").agg(F.avg("price").alias("value"))


@_question("I26_multi_item_orders")
def _(s):
    return _n(s.order_items.groupBy("order_id").agg(F.count("*").alias("items")).where(F.col("items") > 1))


@_question("I27_customers_in_state")
def _(s):
    return _n(s.customers.where(F.col("customer_state") == "NATION_7"))


@_question("I28_freight_in_year")
def _(s):
    orders = _bought(s.orders, date(1998, 1, 1), date(1999, 1, 1)).select("order_id")
    return s.order_items.join(orders, "order_id").agg(F.sum("freight_value").alias("value"))


@_question("I29_largest_category_english")
def _(s):
    named = s.products.join(s.category_translation, "product_category_name")
    return _top(named, "product_category_name_english", F.count("*"), 1).select("product_category_name_english")


@_question("I30_review_late_or_not")
def _(s):
    arrival = F.when(_is_late(), "late").otherwise("on_time").alias("arrival")
    orders = _delivered(s.orders).select("order_id", arrival)
    return orders.join(s.order_reviews, "order_id").groupBy("arrival").agg(F.avg("review_score").alias("value"))
