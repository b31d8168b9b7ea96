"""Plant known defects in copies of the tables, to test that an investigation finds them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from shiftscope.functions.hashing import hash_pick
from shiftscope.session import dealt
from shiftscope.sources.tables import Shop


def _month(orders: DataFrame, start: str, end: str) -> DataFrame:
    at = F.col("order_purchase_timestamp")
    return orders.where((at >= F.lit(date.fromisoformat(start))) & (at < F.lit(date.fromisoformat(end))))


def _of_state(shop: Shop, orders: DataFrame, state: str) -> DataFrame:
    people = shop.customers.where(F.col("customer_state") == state).select("customer_id")
    return orders.join(people, "customer_id", "left_semi")


def _flag(orders: DataFrame, picked: DataFrame) -> DataFrame:
    """Add ``picked`` (true / NULL) to every row whose order is in the pick set."""
    return orders.join(picked.select("order_id").distinct().withColumn("picked", F.lit(True)), "order_id", "left")


def drop_orders(shop: Shop, state: str, start: str, end: str, percent: int) -> Shop:
    """Remove picked orders of one customer state and month, with their items, payments and reviews.

    Large tables are dealt by order to tasks of bounded size, so what is left stays dealt by order.
    """
    gone = _of_state(shop, _month(shop.orders, start, end), state).where(hash_pick(F.col("order_id"), percent)).select("order_id")
    keep = lambda df: dealt(df, "order_id").join(gone, "order_id", "left_anti")
    return shop.replace(
        orders=keep(shop.orders), order_items=keep(shop.order_items), order_payments=keep(shop.order_payments),
        order_reviews=keep(shop.order_reviews),
    )


def delay_deliveries(shop: Shop, state: str, start: str, end: str, percent: int, days: int = 7) -> Shop:
    """Delivered orders of a state and month arrive ``days`` after the promised date."""
    done = _month(shop.orders, start, end).where(F.col("order_status") == "delivered")
    picked = _of_state(shop, done, state).where(hash_pick(F.col("order_id"), percent))
    late = F.col("order_estimated_delivery_date") + F.make_dt_interval(F.lit(days))
    orders = _flag(shop.orders, picked).withColumn(
        "order_delivered_customer_date", F.when(F.col("picked"), late).otherwise(F.col("order_delivered_customer_date"))
    )
    return shop.replace(orders=orders.drop("picked"))


def cancel_orders(shop: Shop, payment_type: str, start: str, end: str, percent: int) -> Shop:
    """Cancel picked orders of a month that were paid by one type."""
    paid = shop.order_payments.where(F.col("payment_type") == payment_type).select("order_id")
    picked = _month(shop.orders, start, end).where(hash_pick(F.col("order_id"), percent)).join(paid, "order_id", "left_semi")
    orders = _flag(shop.orders, picked).withColumn(
        "order_status", F.when(F.col("picked"), F.lit("canceled")).otherwise(F.col("order_status"))
    )
    return shop.replace(orders=orders.drop("picked"))


def worsen_reviews(shop: Shop, category: str, start: str, end: str, percent: int) -> Shop:
    """Picked reviews of orders that contain a category become one-star."""
    wanted = shop.products.where(F.col("product_category_name") == category).select("product_id")
    with_category = shop.order_items.join(wanted, "product_id", "left_semi").select("order_id")
    hit = _month(shop.orders, start, end).select("order_id").join(with_category, "order_id", "left_semi")
    change = F.col("picked") & hash_pick(F.col("review_id"), percent)
    reviews = _flag(shop.order_reviews, hit).withColumn("review_score", F.when(change, F.lit(1)).otherwise(F.col("review_score")))
    return shop.replace(order_reviews=reviews.drop("picked"))


def repeat_payments(shop: Shop, start: str, end: str, percent: int) -> Shop:
    """Every payment row of picked orders appears once more."""
    picked = _month(shop.orders, start, end).where(hash_pick(F.col("order_id"), percent)).select("order_id")
    again = shop.order_payments.join(picked, "order_id", "left_semi")
    return shop.replace(order_payments=shop.order_payments.unionByName(again))
