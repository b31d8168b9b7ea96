"""E: product analytics."""

from __future__ import annotations

from datetime import date

from checks.registry import query
from checks.standin import shop
from shiftscope.operators import product as P

FIRST, LAST = date(1996, 1, 1), date(2001, 1, 1)
_WINDOW = "date '1996-01-01' and {0} < date '2001-01-01'"

_ACTIVE = """act as (select distinct c.customer_unique_id as person, date_trunc('month', o.order_purchase_timestamp)::date as month
    from sh_orders o join sh_customers c using (customer_id) where o.order_status not in ('canceled', 'unavailable'))"""
_COUNTS = _ACTIVE + f""", cc as (select cohort, (datediff('month', cohort, month))::int as months_since_first, count(distinct person) as customers
    from (select person, month, min(month) over (partition by person) as cohort from act)
    where cohort >= {_WINDOW.format('cohort')} group by 1, 2)"""
_GROWTH = _ACTIVE + f""", fl as (select person, month, min(month) over (partition by person) as first_month,
      lag(month) over (partition by person order by month) as before from act),
    churn as (select (a.month + interval '1' month)::date as month, count(*) as churned from act a
      left join act b on b.person = a.person and b.month = (a.month + interval '1' month)::date where b.person is null group by 1),
    growth as (select f.month, count(*) filter (where f.month = first_month) as new,
      count(*) filter (where f.month <> first_month and before = (f.month - interval '1' month)::date) as retained,
      count(*) filter (where f.month <> first_month and before <> (f.month - interval '1' month)::date) as resurrected,
      coalesce(max(churned), 0) as churned from fl f left join churn c on c.month = f.month
      where f.month >= {_WINDOW.format('f.month')} group by 1)"""


@query("E1_funnel", """select step_no, step, orders, orders / first(orders) over (order by step_no)::double as conversion_from_start,
    orders / coalesce(lag(orders) over (order by step_no), orders)::double as conversion_from_previous from (
    select 1 as step_no, 'purchased' as step, count(*) as orders from sh_orders
    union all select 2, 'approved', count(order_approved_at) from sh_orders
    union all select 3, 'shipped', count(order_delivered_carrier_date) from sh_orders
    union all select 4, 'delivered', count(order_delivered_customer_date) from sh_orders
    union all select 5, 'delivered_and_reviewed', count(*) from sh_orders where order_delivered_customer_date is not null
      and order_id in (select order_id from sh_reviews))""")
def _(spark, sf):
    return P.funnel(shop(spark, sf))


@query("E2_cohort_counts", "select * from cc", _COUNTS)
def _(spark, sf):
    return P.cohort_counts(P.active_months(shop(spark, sf)), FIRST, LAST)


@query("E3_cohort_retention", """select cohort, months_since_first, round(customers / size::double, 4) as retention from cc
    join (select cohort, customers as size from cc where months_since_first = 0) using (cohort)""", _COUNTS)
def _(spark, sf):
    return P.cohort_retention(P.cohort_counts(P.active_months(shop(spark, sf)), FIRST, LAST))


@query("E3_cohort_matrix", f"""select cohort, {', '.join(f"coalesce(max(case when months_since_first = {i} then round(customers / size::double, 4) end), 0) as m{i}" for i in range(13))}
    from cc join (select cohort, customers as size from cc where months_since_first = 0) using (cohort) group by 1""", _COUNTS)
def _(spark, sf):
    return P.cohort_matrix(P.cohort_counts(P.active_months(shop(spark, sf)), FIRST, LAST), range(13))


@query("E4_growth_accounting", "select * from growth", _GROWTH)
def _(spark, sf):
    return P.growth_accounting(P.active_months(shop(spark, sf)), FIRST, LAST)


@query("E5_quick_ratio", """select month, new, retained, resurrected, churned, round((new + resurrected) / nullif(churned, 0)::double, 3) as quick_ratio
    from growth""", _GROWTH)
def _(spark, sf):
    return P.quick_ratio(P.growth_accounting(P.active_months(shop(spark, sf)), FIRST, LAST))


@query("E6_unit_economics", f"""select month, count(*) as orders, round(sum(items), 2) as item_revenue, round(avg(items + freight), 2) as avg_order_value,
    round(sum(freight) / nullif(sum(items + freight), 0), 4) as freight_share from (
    select o.order_id, date_trunc('month', o.order_purchase_timestamp)::date as month, sum(price) as items, sum(freight_value) as freight
    from sh_orders o join sh_items i on i.order_id = o.order_id where o.order_status not in ('canceled', 'unavailable') group by 1, 2)
    where month >= {_WINDOW.format('month')} group by 1""")
def _(spark, sf):
    return P.unit_economics(shop(spark, sf), FIRST, LAST)
