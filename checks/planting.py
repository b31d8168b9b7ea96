"""H: planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.standin import shop
from shiftscope.functions.hashing import hash_percent
from shiftscope.operators import planting as P

START, END = "1997-04-01", "1997-05-01"
_IN = "order_purchase_timestamp >= timestamp '1997-04-01' and order_purchase_timestamp < timestamp '1997-05-01'"


def _pick(col: str, percent: int) -> str:
    return f"((('0x' || substr(md5(cast({col} as varchar)), 1, 8))::bigint & 2147483647) % 100 < {percent})"


_GONE = f"gone as (select order_id from sh_orders join sh_customers using (customer_id) where customer_state = 'NATION_3' and {_IN} and {_pick('order_id', 60)})"


@query("H0_hash_pick", "select o_orderkey as order_id, (('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8))::bigint & 2147483647) % 100 as bucket from orders")
def _(spark, sf):
    return shop(spark, sf).orders.select("order_id", hash_percent(F.col("order_id")).alias("bucket"))


@query("H1_drop_orders", """select * from (select 'orders' as table_name, order_id, count(*) as rows_left from sh_orders group by 2
    union all select 'order_items', order_id, count(*) from sh_items group by 2 union all select 'order_payments', order_id, count(*) from sh_payments group by 2
    union all select 'order_reviews', order_id, count(*) from sh_reviews group by 2) where order_id not in (select order_id from gone)""", _GONE)
def _(spark, sf):
    s = P.drop_orders(shop(spark, sf), "NATION_3", START, END, 60)
    out = None
    for t in ("orders", "order_items", "order_payments", "order_reviews"):
        part = s.table(t).groupBy("order_id").agg(F.count("*").alias("rows_left")).withColumn("table_name", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


@query("H2_delay_deliveries", f"""select order_id, order_status, case when order_status = 'delivered' and {_IN} and {_pick('order_id', 40)} and customer_id in
    (select customer_id from sh_customers where customer_state = 'NATION_5') then order_estimated_delivery_date + interval '7' day
    else order_delivered_customer_date end as order_delivered_customer_date from sh_orders""")
def _(spark, sf):
    s = P.delay_deliveries(shop(spark, sf), "NATION_5", START, END, 40)
    return s.orders.select("order_id", "order_status", "order_delivered_customer_date")


@query("H3_cancel_orders", f"""select order_id, case when {_IN} and {_pick('order_id', 50)} and order_id in
    (select order_id from sh_payments where payment_type = 'boleto') then 'canceled' else order_status end as order_status from sh_orders""")
def _(spark, sf):
    return P.cancel_orders(shop(spark, sf), "boleto", START, END, 50).orders.select("order_id", "order_status")


@query("H4_worsen_reviews", f"""select review_id, order_id, case when {_pick('review_id', 70)} and order_id in (select i.order_id from sh_items i
    join sh_orders o on o.order_id = i.order_id join sh_products p on p.product_id = i.product_id
    where product_category_name = 'Brand#2' and {_IN}) then 1 else review_score end as review_score from sh_reviews""")
def _(spark, sf):
    return P.worsen_reviews(shop(spark, sf), "Brand#2", START, END, 70).order_reviews.select("review_id", "order_id", "review_score")


@query("H5_repeat_payments", f"""select order_id, payment_sequential, count(*) as n, round(sum(payment_value), 2) as paid from (select * from sh_payments
    union all select * from sh_payments where order_id in (select order_id from sh_orders where {_IN} and {_pick('order_id', 40)})) group by 1, 2""")
def _(spark, sf):
    p = P.repeat_payments(shop(spark, sf), START, END, 40).order_payments
    return p.groupBy("order_id", "payment_sequential").agg(F.count("*").alias("n"), F.round(F.sum("payment_value"), 2).alias("paid"))
