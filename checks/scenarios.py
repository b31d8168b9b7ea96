"""G: scenario projection per seller state, from its last full month."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.change import rounded
from checks.registry import query
from checks.standin import shop
from shiftscope.operators import scenarios as G

_START = """st as (select seller_state, count(distinct order_id)::double as start_orders, sum(price + freight_value) / count(distinct order_id) as start_aov
    from sh_items join sh_orders using (order_id) join sh_sellers using (seller_id)
    where order_purchase_timestamp >= timestamp '2001-06-01' and order_purchase_timestamp < timestamp '2001-07-01' group by 1),
  sc as (select * from (values ('bear', 0.01, 0.0, 0.10, 0.025, 0.97, 45, 450000, 0.02, 15000000), ('base', 0.03, 0.002, 0.12, 0.022, 0.95, 35, 420000, 0.015, 15000000),
    ('bull', 0.05, 0.004, 0.14, 0.020, 0.92, 28, 400000, 0.01, 15000000)) v(scenario, og, ag, tr, pc, ns, cac, fc, fg, cash)),
  p1 as (select seller_state, scenario, month::int as month, start_orders * pow(1 + og::double, month) as orders, start_aov * pow(1 + ag::double, month) as aov, tr::double as tr,
    pc::double as pc, ns::double as ns, cac, fc * pow(1 + fg::double, month - 1) as fixed_costs, cash from st cross join sc cross join (select unnest(range(1, 37)) as month)),
  p2 as (select *, orders * aov as gmv, orders * aov * tr as net_revenue, orders * aov * pc as payment_costs, orders * ns as new_customers,
    orders * ns * cac as marketing from p1),
  p3 as (select *, net_revenue - payment_costs - marketing as contribution, net_revenue - payment_costs - marketing - fixed_costs as ebitda from p2),
  proj as (select *, cash + sum(ebitda) over (partition by seller_state, scenario order by month) as cash_end from p3)"""
_MONEY = ["gmv", "net_revenue", "payment_costs", "new_customers", "marketing", "contribution", "fixed_costs", "ebitda", "cash_end"]


def _projection(spark, sf):
    s = shop(spark, sf)
    at = F.col("order_purchase_timestamp")
    orders = s.orders.where((at >= F.lit("2001-06-01").cast("date")) & (at < F.lit("2001-07-01").cast("date"))).select("order_id")
    rows = s.order_items.join(orders, "order_id").join(s.sellers, "seller_id")
    start = rows.groupBy("seller_state").agg(
        F.count_distinct("order_id").cast("double").alias("start_orders"),
        (F.sum(F.col("price") + F.col("freight_value")) / F.count_distinct("order_id")).alias("start_aov"))
    return G.project_scenarios(start, "seller_state")


@query("G1_project_scenarios", f"select seller_state, scenario, month, {', '.join(f'round({c} + 3.7e-8, 5) as {c}' for c in ['orders', 'aov', *_MONEY])} from proj", _START)
def _(spark, sf):
    # many values end in an exact 5: a small shift keeps both engines on the same side of the tie
    return _projection(spark, sf).withColumns({c: F.round(F.col(c) + 3.7e-8, 5) for c in ["orders", "aov", *_MONEY]})


@query("G2_scenario_summary", """select seller_state, scenario, round(max(case when month = 12 then gmv end), 2) as gmv_month_12,
    round(max(case when month = 36 then gmv end), 2) as gmv_last_month,
    round(max(case when month = 12 then contribution end) / max(case when month = 12 then net_revenue end), 6) as contribution_margin_month_12,
    min(case when ebitda > 0 then month end) as first_positive_month, round(min(cash_end), 2) as lowest_cash,
    count(*) filter (where cash_end > 0) as months_with_cash from proj group by 1, 2""", _START)
def _(spark, sf):
    out = G.scenario_summary(_projection(spark, sf), "seller_state")
    return rounded(rounded(out, "gmv_month_12", "gmv_last_month", "lowest_cash", digits=2), "contribution_margin_month_12")
