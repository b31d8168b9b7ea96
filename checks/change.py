"""B: period-over-period change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from checks.registry import query
from checks.standin import shop
from shiftscope.operators import change as C
from shiftscope.plans.explain import drill_down, explain_change, investigate
from shiftscope.plans.metrics import DIMENSIONS, metric_catalog
from shiftscope.session import cut_lineage

A, B = ("1997-03-01", "1997-04-01"), ("1997-04-01", "1997-05-01")
SPECS = metric_catalog(A, B)
ALL = tuple(DIMENSIONS)

_A = "order_purchase_timestamp >= timestamp '1997-03-01' and order_purchase_timestamp < timestamp '1997-04-01'"
_B = "order_purchase_timestamp >= timestamp '1997-04-01' and order_purchase_timestamp < timestamp '1997-05-01'"


def _base_sql(value: str, joins: str = "", name: str = "base") -> str:
    return f"""{name} as (select o.order_id, case when {_B} then 'B' else 'A' end as period, {value} as v
        from sh_orders o {joins} where ({_A}) or ({_B}) group by 1, 2)"""


_PAY = "left join sh_payments op on op.order_id = o.order_id"
_ITEM = "left join sh_items oi on oi.order_id = o.order_id"
_REV = "left join sh_reviews r on r.order_id = o.order_id"
_DELIVERED = "o.order_status = 'delivered' and o.order_delivered_customer_date is not null"
_LATE = "o.order_delivered_customer_date > o.order_estimated_delivery_date"
_VALUE = {
    "orders": ("1", ""),
    "delivered_orders": ("max(case when o.order_status = 'delivered' then 1 else 0 end)", ""),
    "revenue": ("sum(op.payment_value)", _PAY),
    "item_revenue": ("sum(oi.price)", _ITEM),
    "freight": ("sum(oi.freight_value)", _ITEM),
    "late_rate": (f"max(case when {_DELIVERED} then case when {_LATE} then 1 else 0 end end)", ""),
    "cancellation_rate": ("max(case when o.order_status = 'canceled' then 1 else 0 end)", ""),
    "review_score": ("avg(r.review_score)", _REV),
    "delivery_days": (
        "max((epoch_us(o.order_delivered_customer_date) - epoch_us(o.order_purchase_timestamp)) / 86400000000.0)", ""),
    "order_value": ("sum(op.payment_value)", _PAY),
}
_DIM_SQL = {
    "customer_state": "select c.customer_state as s, o.order_id from sh_orders o join sh_customers c using (customer_id)",
    "customer_city": "select c.customer_city as s, o.order_id from sh_orders o join sh_customers c using (customer_id)",
    "seller_id": "select cast(seller_id as varchar) as s, order_id from sh_items",
    "seller_state": "select s.seller_state as s, order_id from sh_items join sh_sellers s using (seller_id)",
    "product_category": "select p.product_category_name as s, order_id from sh_items join sh_products p using (product_id)",
    "payment_type": "select payment_type as s, order_id from sh_payments",
}
_SEGS = "segs as (" + " union ".join(
    f"select '{d}' as dimension, order_id, s as segment from ({q})" for d, q in _DIM_SQL.items()) + ")"
_DIMS = "dims as (select unnest(['" + "','".join(ALL) + "']) as dimension)"


def _cut_sql(base: str = "base", name: str = "cut") -> str:
    """Per dimension, segment and period."""
    return f"""{name} as (select d.dimension, coalesce(s.segment, '(none)') as segment, b.period, sum(b.v) as total, count(b.v) as n,
        count(*) as orders from {base} b cross join dims d
        left join segs s on s.order_id = b.order_id and s.dimension = d.dimension group by 1, 2, 3)"""


def _wide_sql(cut: str = "cut", name: str = "wide") -> str:
    side = lambda c, p: f"coalesce(sum(case when period = '{p}' then {c} end), 0)::double as {c}_{p.lower()}"
    return f"""{name} as (select dimension, segment, {side('total', 'A')}, {side('total', 'B')}, {side('n', 'A')}, {side('n', 'B')}
        from {cut} group by 1, 2)"""


def _prep(metric: str) -> str:
    value, joins = _VALUE[metric]
    return ", ".join([_base_sql(value, joins), _SEGS, _DIMS, _cut_sql(), _wide_sql()])


def _change_sql(kind: str, base: str = "base") -> str:
    val = lambda p: (f"coalesce(sum(case when period = '{p}' then v end), 0)" if kind == "total" else
                     f"coalesce(sum(case when period = '{p}' then v end) / nullif(count(case when period = '{p}' then v end), 0), 0)")
    return f"""chg as (select a as value_a, b as value_b, b - a as delta, (b - a) / nullif(a, 0) * 100 as pct_change
        from (select {val('A')}::double as a, {val('B')}::double as b from {base}))"""


_RANK_TOTAL = """ranked as (select w.dimension, segment, total_a as value_a, total_b as value_b, total_b - total_a as delta,
    coalesce(total_a / nullif(sa, 0), 0) * sd as expected_delta,
    total_b - total_a - coalesce(total_a / nullif(sa, 0), 0) * sd as abnormal from wide w
    join (select dimension, sum(total_a) as sa, sum(total_b - total_a) as sd from wide group by 1) t using (dimension))"""
_MIX = """mix as (select *, mix_effect + rate_effect + interaction as total_effect from (
    select dimension, segment, weight_a, weight_b, rate_a, rate_b, (weight_b - weight_a) * rate_a as mix_effect,
    weight_a * (rate_b - rate_a) as rate_effect, (weight_b - weight_a) * (rate_b - rate_a) as interaction from (
    select w.dimension, segment, n_a / na as weight_a, n_b / nb as weight_b, coalesce(total_a / nullif(n_a, 0), 0) as rate_a,
    coalesce(total_b / nullif(n_b, 0), 0) as rate_b from wide w
    join (select dimension, sum(n_a) as na, sum(n_b) as nb from wide group by 1) t using (dimension))))"""
_RANK_RATIO = _MIX + """, ranked as (select dimension, segment, rate_a as value_a, rate_b as value_b, rate_b - rate_a as delta,
    mix_effect, rate_effect, interaction, rate_effect + interaction as abnormal from mix)"""


def _r(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in cols)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# ------------------------------------------------------------------ B3..B6
@query("B3_base_values", "select order_id, period, round(v, 4) as v from base", _base_sql(*_VALUE["revenue"]))
def _(spark, sf):
    return rounded(C.base_values(shop(spark, sf), SPECS["revenue"]), "v", digits=4)


@query("B4_total_by_period", "select period, round(sum(v), 2) as total, count(v) as n, count(*) as orders from base group by 1",
       _base_sql(*_VALUE["revenue"]))
def _(spark, sf):
    return rounded(C.total_by_period(C.base_values(shop(spark, sf), SPECS["revenue"])), "total", digits=2)


@query("B5_segment_by_period",
       "select segment, period, total, n, orders from cut where dimension = 'customer_state'", _prep("orders"))
def _(spark, sf):
    s = shop(spark, sf)
    base = C.base_values(s, SPECS["orders"])
    return C.by_segment(base, C.segment_rows(s, ["customer_state"], base), ["customer_state"]).drop("dimension")


def _all_cut(spark, sf, metric):
    s = shop(spark, sf)
    base = cut_lineage(C.base_values(s, SPECS[metric]))
    return C.by_segment(base, C.segment_rows(s, ALL, base), ALL)


@query("B6_all_dimensions", "select dimension, segment, period, round(total, 2) as total, n, orders from cut", _prep("revenue"))
def _(spark, sf):
    return rounded(_all_cut(spark, sf, "revenue"), "total", digits=2)


# ------------------------------------------------------------------ B7..B8
_DUP = f"""dup as ({' union all '.join(f'''select '{t}' as table_name, case when {_B} then 'B' else 'A' end as period,
    count(*) as row_count, count(distinct {k}) as distinct_keys from {frm} where ({_A}) or ({_B}) group by 2''' for t, k, frm in [
    ('orders', 'o.order_id', 'sh_orders o'),
    ('order_items', '(oi.order_id, oi.order_item_id)', 'sh_orders o join sh_items oi on oi.order_id = o.order_id'),
    ('order_payments', '(op.order_id, op.payment_sequential)', 'sh_orders o join sh_payments op on op.order_id = o.order_id'),
    ('products', 'p.product_id', 'sh_orders o join sh_items oi on oi.order_id = o.order_id join sh_products p on p.product_id = oi.product_id'),
    ('customers', 'c.customer_id', 'sh_orders o join sh_customers c on c.customer_id = o.customer_id')])})"""
_DUP_TABLES = ["orders", "order_items", "order_payments", "products", "customers"]


@query("B7_duplicate_check", "select * from dup", _DUP)
def _(spark, sf):
    return C.duplicate_checks(shop(spark, sf), SPECS["revenue"], _DUP_TABLES)


@query("B8_drill_filter",
       "select order_id, period, v from base where order_id in (select order_id from segs where dimension = 'payment_type' and segment = 'boleto')",
       ", ".join([_base_sql("1"), _SEGS]))
def _(spark, sf):
    s = shop(spark, sf)
    base = C.base_values(s, SPECS["orders"])
    return C.orders_in_segment(base, C.segment_rows(s, ["payment_type"], base), "payment_type", "boleto")


# ------------------------------------------------------------------ B9..B15
def _wide(spark, sf, metric):
    return C.pivot_periods(_all_cut(spark, sf, metric))


@query("B9_pivot_periods", f"select dimension, segment, {_r('total_a', 'total_b', digits=2)}, n_a, n_b from wide", _prep("revenue"))
def _(spark, sf):
    return rounded(_wide(spark, sf, "revenue"), "total_a", "total_b", digits=2)


@query("B10_total_change", f"select {_r('value_a', 'value_b', 'delta', 'pct_change', digits=4)} from chg",
       ", ".join([_base_sql(*_VALUE["late_rate"]), _change_sql("per_order_average")]))
def _(spark, sf):
    totals = C.total_by_period(C.base_values(shop(spark, sf), SPECS["late_rate"]))
    return rounded(C.total_change(totals, "per_order_average"), "value_a", "value_b", "delta", "pct_change", digits=4)


@query("B10_period_change", f"""select dimension, segment, {_r('value_a', 'value_b', 'delta', digits=2)}, round(pct_change, 4) as pct_change from (
    select dimension, segment, total_a as value_a, total_b as value_b, total_b - total_a as delta,
    (total_b - total_a) / nullif(total_a, 0) * 100 as pct_change from wide)""", _prep("revenue"))
def _(spark, sf):
    wide = _wide(spark, sf, "revenue").select("dimension", "segment", F.col("total_a").alias("value_a"), F.col("total_b").alias("value_b"))
    return rounded(rounded(C.period_change(wide), "value_a", "value_b", "delta", digits=2), "pct_change", digits=4)


@query("B11_segment_contributions", """select dimension, segment, total_a, total_b, total_b - total_a as delta,
    round((total_b - total_a) / nullif(total_a, 0) * 100, 6) as pct_change,
    round(coalesce((total_b - total_a) / nullif(sd, 0), 0), 6) as share_of_change from wide
    join (select dimension, sum(total_b - total_a) as sd from wide group by 1) using (dimension)""", _prep("orders"))
def _(spark, sf):
    wide = _wide(spark, sf, "orders").drop("n_a", "n_b")
    return rounded(C.segment_contributions(wide, "total_a", "total_b"), "pct_change", "share_of_change")


@query("B12_rank_abnormal_total", f"""select dimension, segment, {_r('value_a', 'value_b', 'delta', digits=2)},
    {_r('expected_delta', 'abnormal', digits=3)}, round(coalesce(abnormal / nullif((select delta from chg), 0), 0), 6) as share_of_change
    from ranked""", ", ".join([_prep("revenue"), _change_sql("total"), _RANK_TOTAL]))
def _(spark, sf):
    inv = investigate(shop(spark, sf), SPECS["revenue"])
    out = C.rank_abnormal_total(inv.wide, inv.change.select("delta").scalar())
    out = rounded(out, "value_a", "value_b", "delta", digits=2)
    return rounded(rounded(out, "expected_delta", "abnormal", digits=3), "share_of_change")


_MIX_COLS = ["weight_a", "weight_b", "rate_a", "rate_b", "mix_effect", "rate_effect", "interaction", "total_effect"]


@query("B13_mix_rate_segments", f"select dimension, segment, {_r(*_MIX_COLS)} from mix", ", ".join([_prep("late_rate"), _MIX]))
def _(spark, sf):
    return rounded(C.mix_rate_segments(_wide(spark, sf, "late_rate")), *_MIX_COLS)


@query("B13_mix_rate_totals", f"""select dimension, {_r('rate_a', 'rate_b', 'delta', 'mix_effect', 'rate_effect', 'interaction')} from (
    select dimension, sum(total_a) / sum(n_a) as rate_a, sum(total_b) / sum(n_b) as rate_b,
    sum(total_b) / sum(n_b) - sum(total_a) / sum(n_a) as delta from wide group by 1)
    join (select dimension, sum(mix_effect) as mix_effect, sum(rate_effect) as rate_effect, sum(interaction) as interaction
    from mix group by 1) using (dimension)""", ", ".join([_prep("late_rate"), _MIX]))
def _(spark, sf):
    return rounded(C.mix_rate_totals(_wide(spark, sf, "late_rate")), "rate_a", "rate_b", "delta", "mix_effect", "rate_effect", "interaction")


_RATIO_COLS = ["value_a", "value_b", "delta", "mix_effect", "rate_effect", "interaction", "abnormal"]


@query("B14_rank_abnormal_ratio", f"""select dimension, segment, {_r(*_RATIO_COLS)},
    round(coalesce(abnormal / nullif((select delta from chg), 0), 0), 6) as share_of_change from ranked""",
       ", ".join([_prep("late_rate"), _change_sql("per_order_average"), _RANK_RATIO]))
def _(spark, sf):
    inv = investigate(shop(spark, sf), SPECS["late_rate"])
    return rounded(C.rank_abnormal_ratio(inv.wide, inv.change.select("delta").scalar()), *_RATIO_COLS, "share_of_change")


def _candidates_sql(rank: str, kind: str) -> str:
    return f"""{_change_sql(kind)}, {rank}, cand as (select dimension, segment, value_a, value_b, delta as change, abnormal as abnormal_change,
        coalesce(abnormal / nullif((select delta from chg), 0), 0) as share_of_change from (select *, row_number() over
        (partition by dimension order by abs(abnormal) desc, segment) as place from ranked) where place <= 3 and segment <> '(none)')"""


_CAND_COLS = ["value_a", "value_b", "change", "abnormal_change", "share_of_change"]


@query("B15_top_candidates", f"select dimension, segment, {_r(*_CAND_COLS, digits=4)} from cand",
       ", ".join([_prep("orders"), _candidates_sql(_RANK_TOTAL, "total")]))
def _(spark, sf):
    return investigate(shop(spark, sf), SPECS["orders"]).candidates


@query("B15_top_candidates_ratio", f"select dimension, segment, {_r(*_CAND_COLS, digits=4)} from cand",
       ", ".join([_prep("cancellation_rate"), _candidates_sql(_RANK_RATIO, "per_order_average")]))
def _(spark, sf):
    return investigate(shop(spark, sf), SPECS["cancellation_rate"]).candidates


# ------------------------------------------------------------------ B16..B20
_FIND = """rates as (select table_name, max(case when period = 'A' then (row_count - distinct_keys) / row_count::double end) as duplicate_rate_a,
    max(case when period = 'B' then (row_count - distinct_keys) / row_count::double end) as duplicate_rate_b from dup group by 1),
    found as (select *, duplicate_rate_b - duplicate_rate_a as increase from rates where duplicate_rate_b - duplicate_rate_a > 0.005)"""


@query("B16_duplicate_findings", f"select table_name, {_r('duplicate_rate_a', 'duplicate_rate_b', 'increase')} from found", f"{_DUP}, {_FIND}")
def _(spark, sf):
    checks = C.duplicate_checks(shop(spark, sf), SPECS["revenue"], _DUP_TABLES)
    return rounded(C.duplicate_findings(checks), "duplicate_rate_a", "duplicate_rate_b", "increase")


def _verdict_sql(found: str) -> str:
    return f"""verdict as (select case when (select count(*) from {found}) > 0 then 'high' when abs(pct_change) < 2 then 'no_significant_change'
        when (select count(*) from cand) = 0 then 'low' when (select max(abs(share_of_change)) from cand) >= 0.5 then 'high'
        when (select max(abs(share_of_change)) from cand) >= 0.25 then 'medium' else 'low' end as confidence from chg)"""


_NO_FIND = "nofound as (select 1 where false)"


@query("B17_confidence", "select confidence from verdict",
       ", ".join([_prep("orders"), _candidates_sql(_RANK_TOTAL, "total"), _NO_FIND, _verdict_sql("nofound")]))
def _(spark, sf):
    inv = investigate(shop(spark, sf), SPECS["orders"])
    return C.confidence(inv.change, inv.candidates, inv.findings)


def _drill_sql(limit: int = 3) -> str:
    """Totals only: the same ranking inside the best candidate."""
    return f"""best as (select dimension, segment from cand order by abs(round(share_of_change, 4)) desc, dimension, segment limit 1),
        inside as (select * from base where order_id in (select s.order_id from segs s join best using (dimension, segment))),
        dcut as (select * from ({_cut_sql('inside', 'x')[len('x as ('):-1]}) where dimension <> (select dimension from best)),
        {_wide_sql('dcut', 'dwide')},
        dranked as (select d.dimension, segment, total_a as value_a, total_b as value_b,
          total_b - total_a - coalesce(total_a / nullif(sa, 0), 0) * sd as abnormal,
          coalesce((total_b - total_a - coalesce(total_a / nullif(sa, 0), 0) * sd) / nullif(sd, 0), 0) as share_of_change from dwide d
          join (select dimension, sum(total_a) as sa, sum(total_b - total_a) as sd from dwide group by 1) t using (dimension)),
        drill as (select dimension, segment, value_a, value_b, share_of_change from (select *, row_number() over
          (partition by dimension order by abs(abnormal) desc, segment) as place from dranked)
          where place = 1 and segment <> '(none)' order by abs(share_of_change) desc, dimension limit {limit})"""


@query("B18_drill_down", f"select dimension, segment, value_a, value_b, round(share_of_change, 6) as share_of_change from drill",
       ", ".join([_prep("orders"), _candidates_sql(_RANK_TOTAL, "total"), _drill_sql()]))
def _(spark, sf):
    inv = investigate(shop(spark, sf), SPECS["orders"])
    top = inv.top_candidate()
    return rounded(drill_down(inv, top["dimension"], top["segment"]), "share_of_change")


@query("B19_quality_override", """select 0 as priority, 'data_quality' as dimension, table_name as segment, cast(null as double) as share_of_change,
    round(duplicate_rate_b, 6) as duplicate_rate_b from found union all
    select 1, dimension, segment, round(share_of_change, 4), null from cand""",
       ", ".join([_prep("revenue"), _candidates_sql(_RANK_TOTAL, "total"), _DUP, _FIND]))
def _(spark, sf):
    s = shop(spark, sf)
    inv = investigate(s, SPECS["revenue"])
    findings = C.duplicate_findings(C.duplicate_checks(s, SPECS["revenue"], _DUP_TABLES))
    return rounded(C.quality_override(inv.candidates, findings), "duplicate_rate_b")


@query("B20_explain_change", f"""
    select 'change' as section, 1 as place, cast(null as varchar) as dimension, 'orders' as segment, value_a, value_b, delta as change,
      round(pct_change / 100, 6) as share_of_change, cast(null as varchar) as note from chg
    union all select 'candidate', place, dimension, segment, round(value_a, 6), round(value_b, 6), round(change, 6), round(share_of_change, 4), null from (
      select *, row_number() over (order by abs(round(share_of_change, 4)) desc, dimension, segment)::int as place from cand) where place <= 5
    union all select 'confidence', 1, null, confidence, null, null, null, null, case confidence when 'low' then 'insufficient_evidence'
      when 'no_significant_change' then 'no_significant_change' else 'ok' end from verdict
    union all select 'drill_down', row_number() over (order by abs(share_of_change) desc, dimension)::int, dimension, segment, value_a, value_b,
      value_b - value_a, round(share_of_change, 6), (select 'inside ' || dimension || '=' || segment from best) from drill""",
       ", ".join([_prep("orders"), _candidates_sql(_RANK_TOTAL, "total"), _NO_FIND, _verdict_sql("nofound"), _drill_sql()]))
def explain_orders(spark, sf):
    return rounded(explain_change(shop(spark, sf), SPECS["orders"]), "share_of_change")


# ------------------------------------------------------------------ B21..B22
def _catalog_sql() -> tuple[str, str]:
    ctes, parts = [], []
    for metric, (value, joins) in _VALUE.items():
        ctes.append(_base_sql(value, joins, f"base_{metric}"))
        val = lambda p: (f"coalesce(sum(case when period = '{p}' then v end), 0)" if SPECS[metric].kind == "total" else  # noqa: E731,B023
                         f"coalesce(avg(case when period = '{p}' then v end), 0)")
        parts.append(f"select '{metric}' as metric, {val('A')}::double as value_a, {val('B')}::double as value_b from base_{metric}")
    body = " union all ".join(parts)
    return (f"""select metric, {_r('value_a', 'value_b', digits=4)}, round(value_b - value_a, 4) as delta,
        round((value_b - value_a) / nullif(value_a, 0) * 100, 4) as pct_change from ({body})""", ", ".join(ctes))


@query("B21_metric_catalog", *_catalog_sql())
def _(spark, sf):
    s = shop(spark, sf)
    parts = [C.total_change(C.total_by_period(C.base_values(s, m)), m.kind).select(F.lit(n).alias("metric"), "*") for n, m in SPECS.items()]
    return rounded(reduce(DataFrame.unionByName, parts), "value_a", "value_b", "delta", "pct_change", digits=4)


@query("B22_conditional_pivot", f"""select customer_state as segment, coalesce(sum(case when {_A} then 1 end), 0)::bigint as value_a,
    coalesce(sum(case when {_B} then 1 end), 0)::bigint as value_b from sh_orders join sh_customers using (customer_id) group by 1""")
def _(spark, sf):
    s = shop(spark, sf)
    rows = s.orders.join(s.customers, "customer_id").withColumn("one", F.lit(1))
    return C.conditional_pivot(rows, "customer_state", "order_purchase_timestamp", "one", A, B)


@query("B22_row_number", """select customer_id, order_id, row_number() over (partition by customer_id order by order_purchase_timestamp, order_id)
    as visit from sh_orders""")
def _(spark, sf):
    from shiftscope.functions.ordered import positions

    orders = shop(spark, sf).orders.withColumn("at", F.unix_micros(F.col("order_purchase_timestamp").cast("timestamp")))
    return positions(orders, ["customer_id"], "at", ["order_id"], out="visit").select("customer_id", "order_id", "visit")
