"""C and D: star schema and dashboard measures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks.change import rounded
from checks.registry import query
from checks.standin import shop
from shiftscope.operators import mart as M, measures as D
from shiftscope.sources.tables import row_counts

_DATE = """select d::date as date_key, year(d)::int as year, quarter(d)::int as quarter, month(d)::int as month,
    strftime(d, '%Y-%m') as year_month, isodow(d)::int as weekday, isodow(d) in (6, 7) as is_weekend
    from (select unnest(generate_series({}, {}, interval '1' day)) as d)"""
_PRODUCT = """select product_id, coalesce(product_category_name, 'unknown') as category,
    coalesce(product_category_name_english, 'unknown') as category_english, product_weight_g, product_photos_qty
    from sh_products left join sh_translation using (product_category_name)"""
_DAYS = "(epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 86400000000.0"
_LATE = """case when order_status = 'delivered' and order_delivered_customer_date is not null
    then (order_delivered_customer_date > order_estimated_delivery_date)::int end"""
_ITEMS = f"""fi as (select i.order_id, i.order_item_id, o.customer_id, i.seller_id, i.product_id, o.order_purchase_timestamp::date as purchase_date_key,
    o.order_status, i.price, i.freight_value, i.price + i.freight_value as item_total, {_LATE} as is_late, {_DAYS} as delivery_days, r.review_score
    from sh_items i join sh_orders o on o.order_id = i.order_id
    left join (select order_id, avg(review_score) as review_score from sh_reviews group by 1) r on r.order_id = i.order_id)"""
_PAYMENTS = """fp as (select p.order_id, p.payment_sequential, o.customer_id, o.order_purchase_timestamp::date as purchase_date_key,
    p.payment_type, p.payment_installments, p.payment_value from sh_payments p join sh_orders o on o.order_id = p.order_id)"""


_SPAN = "(select min(o_orderdate)::date::timestamp from orders)", "(select max(o_orderdate)::date::timestamp from orders)"


@query("C1_dim_date", _DATE.format(*_SPAN))
def _(spark, sf):
    first, last = shop(spark, sf).orders.agg(F.to_date(F.min("order_purchase_timestamp")), F.to_date(F.max("order_purchase_timestamp"))).first()
    return M.dim_date(spark, first, last)


@query("C1_dim_date_of_orders", """select d::date as date_key, year(d)::int as year, month(d)::int as month, isodow(d)::int as weekday
    from (select unnest(generate_series((select min(o_orderdate)::date::timestamp from orders),
    (select max(o_orderdate)::date::timestamp from orders), interval '1' day)) as d)""")
def _(spark, sf):
    first, last = shop(spark, sf).orders.agg(F.to_date(F.min("order_purchase_timestamp")), F.to_date(F.max("order_purchase_timestamp"))).first()
    return M.dim_date(spark, first, last).select("date_key", "year", "month", "weekday")


@query("C2_dim_customer", "select customer_id, customer_unique_id, customer_city, customer_state from sh_customers")
def _(spark, sf):
    return M.dim_customer(shop(spark, sf))


@query("C3_dim_seller", "select seller_id, seller_city, seller_state from sh_sellers")
def _(spark, sf):
    return M.dim_seller(shop(spark, sf))


@query("C4_dim_product", _PRODUCT)
def _(spark, sf):
    return M.dim_product(shop(spark, sf))


@query("C5_fact_order_items", """select order_id, order_item_id, customer_id, seller_id, product_id, purchase_date_key, order_status, price,
    round(freight_value, 6) as freight_value, round(item_total, 6) as item_total, is_late, round(delivery_days, 6) as delivery_days,
    round(review_score, 6) as review_score from fi""", _ITEMS)
def _(spark, sf):
    return rounded(M.fact_order_items(shop(spark, sf)), "freight_value", "item_total", "delivery_days", "review_score")


@query("C6_fact_payments", "select * from fp", _PAYMENTS)
def _(spark, sf):
    return M.fact_payments(shop(spark, sf))


@query("C7_mart_counts", f"""select 'dim_date' as table_name, count(*) as row_count from ({_DATE.format(*_SPAN)})
    union all select 'dim_customer', count(*) from sh_customers union all select 'dim_seller', count(*) from sh_sellers
    union all select 'dim_product', count(*) from ({_PRODUCT}) union all select 'fact_order_items', count(*) from fi
    union all select 'fact_payments', count(*) from fp""", f"{_ITEMS}, {_PAYMENTS}")
def _(spark, sf):
    return row_counts(M.build_mart(shop(spark, sf), spark))


# ------------------------------------------------------------------ measures
@query("D1_orders", "select count(distinct order_id) as orders from fi", _ITEMS)
def _(spark, sf):
    return M.fact_order_items(shop(spark, sf)).agg(D.orders_measure().alias("orders"))


@query("D1_orders_by_month", "select date_trunc('month', purchase_date_key)::date as month, count(distinct order_id) as orders from fi group by 1", _ITEMS)
def _(spark, sf):
    return D.item_measures(D.monthly(M.fact_order_items(shop(spark, sf))), ["month"]).select("month", "orders")


@query("D1_orders_sketched", """select date_trunc('quarter', purchase_date_key)::date as quarter, true as near from fi group by 1""", _ITEMS)
def _(spark, sf):
    # a sketch a month, merged to quarters, against the exact counts
    items = D.monthly(M.fact_order_items(shop(spark, sf)))
    quarter = F.date_trunc("quarter", "month").cast("date").alias("quarter")
    sketched = D.sketched_orders(D.order_sketches(items, ["month"]).select("sketch", quarter), ["quarter"])
    exact = items.groupBy(quarter).agg(F.count_distinct("order_id").alias("exact"))
    return sketched.join(exact, "quarter").select("quarter", (F.abs(F.col("orders") / F.col("exact") - 1) < 0.03).alias("near"))


@query("D2_gmv", "select round(sum(payment_value), 2) as gmv from fp", _PAYMENTS)
def _(spark, sf):
    return rounded(D.gmv(M.fact_payments(shop(spark, sf))), "gmv", digits=2)


def _measures(spark, sf, by=()):
    items = M.fact_order_items(shop(spark, sf))
    return D.item_measures(D.monthly(items) if by else items, by)


@query("D3_item_revenue", "select round(sum(price), 2) as item_revenue from fi", _ITEMS)
def _(spark, sf):
    return rounded(_measures(spark, sf).select("item_revenue"), "item_revenue", digits=2)


@query("D4_average_order_value", """select date_trunc('month', purchase_date_key)::date as month,
    round(sum(item_total) / count(distinct order_id), 4) as average_order_value from fi group by 1""", _ITEMS)
def _(spark, sf):
    return rounded(_measures(spark, sf, ["month"]).select("month", "average_order_value"), "average_order_value", digits=4)


@query("D5_freight_share", """select date_trunc('month', purchase_date_key)::date as month,
    round(sum(freight_value) / sum(item_total), 6) as freight_share from fi group by 1""", _ITEMS)
def _(spark, sf):
    return rounded(_measures(spark, sf, ["month"]).select("month", "freight_share"), "freight_share")


@query("D6_late_rate", """select date_trunc('month', purchase_date_key)::date as month, round(count(distinct case when is_late = 1 then order_id end)
    / nullif(count(distinct case when is_late is not null then order_id end), 0)::double, 6) as late_rate from fi group by 1""", _ITEMS)
def _(spark, sf):
    return rounded(_measures(spark, sf, ["month"]).select("month", "late_rate"), "late_rate")


@query("D7_avg_review_score", """select date_trunc('month', purchase_date_key)::date as month, round(avg(review_score), 9) as avg_review_score
    from fi group by 1""", _ITEMS)
def _(spark, sf):
    return rounded(_measures(spark, sf, ["month"]).select("month", "avg_review_score"), "avg_review_score", digits=9)


@query("D8_orders_mom", """select m.month, m.orders, p.orders as previous, round((m.orders - p.orders) / p.orders::double, 6) as change from mo m
    left join mo p on p.month = m.month - interval '1' month""",
       f"{_ITEMS}, mo as (select date_trunc('month', purchase_date_key)::date as month, count(distinct order_id) as orders from fi group by 1)")
def _(spark, sf):
    monthly = _measures(spark, sf, ["month"]).select("month", "orders")
    return rounded(D.month_over_month(monthly, "orders"), "change")


@query("D9_gmv_ytd", """select month, round(gmv, 2) as gmv, round(sum(gmv) over (partition by year(month) order by month), 2) as gmv_ytd
    from (select date_trunc('month', purchase_date_key)::date as month, sum(payment_value) as gmv from fp group by 1)""", _PAYMENTS)
def _(spark, sf):
    monthly = D.gmv(D.monthly(M.fact_payments(shop(spark, sf))), ["month"])
    return rounded(D.year_to_date(monthly, "gmv", "gmv_ytd"), "gmv", "gmv_ytd", digits=2)


@query("D10_repeated_payment_rows", """select date_trunc('month', purchase_date_key)::date as month,
    count(*) - count(distinct (order_id, payment_sequential)) as repeated_rows from fp group by 1""", _PAYMENTS)
def _(spark, sf):
    return D.repeated_payment_rows(D.monthly(M.fact_payments(shop(spark, sf))), ["month"])


def _order_days(spark, sf):
    return shop(spark, sf).orders.select(
        "order_status", D.month_of(F.col("order_purchase_timestamp")).alias("month"),
        M.days_between(F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")).alias("delivery_days"))


@query("D11_order_rates", f"""select date_trunc('month', order_purchase_timestamp)::date as month,
    round(avg(case when order_status = 'canceled' then 1 else 0 end), 6) as cancellation_rate,
    round(avg({_DAYS}), 6) as avg_delivery_days from sh_orders group by 1""")
def _(spark, sf):
    return rounded(D.order_rates(_order_days(spark, sf), ["month"]), "cancellation_rate", "avg_delivery_days")


@query("D12_late_rate_by_customer_state", """select customer_state, round(count(distinct case when is_late = 1 then order_id end)
    / count(distinct order_id)::double, 6) as late_rate, count(distinct order_id) as orders
    from fi join sh_customers using (customer_id) where is_late is not null group by 1""", _ITEMS)
def _(spark, sf):
    s = shop(spark, sf)
    return rounded(D.late_rate_by(M.fact_order_items(s), M.dim_customer(s), "customer_id", "customer_state"), "late_rate")


@query("D12_late_rate_by_seller_state", """select seller_state, round(count(distinct case when is_late = 1 then order_id end)
    / count(distinct order_id)::double, 6) as late_rate, count(distinct order_id) as orders
    from fi join sh_sellers using (seller_id) where is_late is not null group by 1""", _ITEMS)
def _(spark, sf):
    s = shop(spark, sf)
    return rounded(D.late_rate_by(M.fact_order_items(s), M.dim_seller(s), "seller_id", "seller_state"), "late_rate")


@query("D12_delivery_days_histogram", f"""select least(floor({_DAYS} / 5.0), 9)::int as bucket, count(*) as orders from sh_orders
    where order_delivered_customer_date is not null group by 1""")
def _(spark, sf):
    return D.delivery_days_histogram(_order_days(spark, sf))
