"""J1-J10: daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.change import rounded
from checks.registry import query
from checks.standin import shop, table
from shiftscope.operators import series as S

_EV = """ev as (select event_type as series, ts::date as day, sum(value) as value from events where not (extract(day from ts) in (9, 10) and event_type = 'view') group by 1, 2),
  filled as (select series, day, coalesce(value, case when nv is null then pv else pv + (nv - pv) * (day - pd)::double / nullif((nd - pd), 0) end) as value from (
    select s.series, s.day, e.value,
      last_value(e.value ignore nulls) over (partition by s.series order by s.day rows between unbounded preceding and current row) as pv,
      last_value(case when e.value is not null then s.day end ignore nulls) over (partition by s.series order by s.day rows between unbounded preceding and current row) as pd,
      first_value(e.value ignore nulls) over (partition by s.series order by s.day rows between current row and unbounded following) as nv,
      first_value(case when e.value is not null then s.day end ignore nulls) over (partition by s.series order by s.day rows between current row and unbounded following) as nd
    from (select series, unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval '1' day))::date as day from ev group by series) s
    left join ev e on e.series = s.series and e.day = s.day))"""
_ORD = """daily as (select order_purchase_timestamp::date as day, count(*)::double as orders,
    avg(case when order_status = 'canceled' then 1.0 else 0 end) as canceled_rate,
    avg(case when order_status = 'delivered' and order_delivered_customer_date is not null
      then (order_delivered_customer_date > order_estimated_delivery_date)::int end) as late_rate
    from sh_orders where order_purchase_timestamp >= timestamp '1999-03-01' and order_purchase_timestamp < timestamp '2000-08-15' group by 1),
  raw as (select 'orders' as series, day, orders as value from daily union all select 'canceled_rate', day, canceled_rate from daily
    union all select 'late_rate', day, late_rate from daily),
  ser as (select series, day, coalesce(value, case when nv is null then pv else pv + (nv - pv) * (day - pd)::double / nullif((nd - pd), 0) end) as value from (
    select s.series, s.day, e.value,
      last_value(e.value ignore nulls) over (partition by s.series order by s.day rows between unbounded preceding and current row) as pv,
      last_value(case when e.value is not null then s.day end ignore nulls) over (partition by s.series order by s.day rows between unbounded preceding and current row) as pd,
      first_value(e.value ignore nulls) over (partition by s.series order by s.day rows between current row and unbounded following) as nv,
      first_value(case when e.value is not null then s.day end ignore nulls) over (partition by s.series order by s.day rows between current row and unbounded following) as nd
    from (select series, unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval '1' day))::date as day from raw group by series) s
    left join raw e on e.series = s.series and e.day = s.day))"""
_PARTS = _ORD + """, tr as (select *, avg(value) over (partition by series order by day rows between 3 preceding and 3 following) as trend from ser),
  parts as (select t.series, day, value, trend, seasonal, value - trend - seasonal as resid from tr t
    join (select series, isodow(day) as wd, median(value - trend) as seasonal from tr group by 1, 2) e on e.series = t.series and e.wd = isodow(day))"""


def event_series(spark, sf):
    """Value per event type and day, with two days of one type missing so that a gap is filled."""
    rows = table(spark, sf, "events").where(~(F.dayofmonth("ts").isin(9, 10) & (F.col("event_type") == "view")))
    return S.fill_days(S.daily_values(rows, F.col("event_type"), "ts", F.sum("value")))


def shop_series(spark, sf):
    return S.fill_days(S.order_series(shop(spark, sf).orders, "1999-03-01", "2000-08-15"))


@query("J1_daily_series", "select series, day, round(value, 4) as value from filled", _EV)
def _(spark, sf):
    return rounded(event_series(spark, sf), "value", digits=4)


@query("J1_order_series", "select series, day, round(value, 6) as value from ser", _ORD)
def _(spark, sf):
    return rounded(shop_series(spark, sf), "value")


@query("J2_seasonal_decompose")
def _(spark, sf):
    return S.seasonal_decompose(shop_series(spark, sf))


@query("J2_stl_anomalies")
def _(spark, sf):
    return S.robust_anomalies(S.seasonal_decompose(shop_series(spark, sf)), 3.0)


@query("J3_seasonal_residual", """select series, day, round(value, 6) as value, round(trend, 6) as trend, round(seasonal, 6) as seasonal,
    round(resid, 6) as resid from parts""", _PARTS)
def _(spark, sf):
    return rounded(S.seasonal_residual(shop_series(spark, sf)), "value", "trend", "seasonal", "resid")


@query("J4_robust_anomalies", """select series, day, round(value, 4) as value, round(trend + seasonal, 4) as expected, round(z, 2) as robust_z from (
    select p.*, 0.6745 * (resid - mid) / case when mad = 0 then 1e-9 else mad end as z from parts p
    join (select series, median(resid) as mid from parts group by 1) using (series)
    join (select p.series, median(abs(resid - mid)) as mad from parts p join (select series, median(resid) as mid from parts group by 1) m
      on m.series = p.series group by 1) using (series)) where abs(z) >= 2.5""", _PARTS)
def _(spark, sf):
    return S.robust_anomalies(S.seasonal_residual(shop_series(spark, sf)), 2.5)


@query("J5_seasonal_naive", """select series, step::int as step, round(value, 6) as prediction from (
    select *, row_number() over (partition by series order by day desc) as age from ser)
    join (select unnest(range(1, 29)) as step) on (step - 1) % 7 = 7 - age where age <= 7""", _ORD)
def _(spark, sf):
    return rounded(S.seasonal_naive(shop_series(spark, sf)), "prediction")


def _search(source: str, grid: str, name: str) -> str:
    """CTEs name (one row per parameters and day) and name_best (the parameters of least squared error) over the rows of ``source``."""
    return f"""{name}_grid as ({grid}),
  {name} as (select series, a, b, g, p, 0 as t, 0.0::double as sse, l as level, (l2 - l) / 7 as slope, s from {name}_grid join hw_start using (series) union all
    select series, a, b, g, p, t + 1, sse + m * m, level + p * slope + a * m, p * slope + b * (a * m), list_append(s[2:7], s[1] + g * m)
    from (select h.*, o.y - (level + p * slope + s[1]) as m from {name} h join hw_day o on o.series = h.series and o.t = h.t)),
  {name}_best as (select * exclude (n) from {name} join hw_start using (series) where t = n qualify row_number() over (partition by series order by sse, a, b, g, p) = 1)"""


_NEAR = {name: f"unnest(list_distinct([{', '.join(f'least(greatest({name} + ({w * k!r})::double, {low}), {high})' for k in (-1.0, -0.5, 0.0, 0.5, 1.0))}])) as {name}" for name, (_, w, low, high) in S.GRID.items()}
_HW = _ORD + """, hw_day as (select series, row_number() over (partition by series order by day) - 1 as t, value::double as y from ser where value is not null),
  hw_start as (select series, n, l, l2, list_transform(w, lambda x: x - l) as s from (select series, count(*) as n, avg(y) filter (where t < 7) as l, avg(y) filter (where t between 7 and 13) as l2,
    list(y order by t) filter (where t < 7) as w from hw_day group by 1) where n >= 14),
  """ + _search("hw_start", "select series, a, b, g, p from hw_start, " + ", ".join(f"(select unnest({values}::double[]) as {n})" for n, (values, *_) in S.GRID.items()), "h1") + """,
  """ + _search("h1_best", f"""select series, a, b, g, {_NEAR['p']} from (select series, a, b, {_NEAR['g']}, p from (select series, a, {_NEAR['b']}, g, p from (select series, {_NEAR['a']}, b, g, p from h1_best)))""", "h2")


@query("J6_holt_winters", """select series, step::int as step, round(level + slope * list_sum(list_transform(range(1, step + 1), lambda k: pow(p, k))) + s[(step - 1) % 7 + 1], 4) as prediction
    from h2_best, (select unnest(range(1, 29)) as step)""", _HW)
def _(spark, sf):
    return rounded(S.holt_winters(shop_series(spark, sf)), "prediction", digits=4)


@query("J7_lag_features", """select series, day, round(value, 6) as value, round(lag(value, 7) over w, 6) as lag_7, round(lag(value, 14) over w, 6) as lag_14,
    round(lag(value, 21) over w, 6) as lag_21, round(lag(value, 28) over w, 6) as lag_28,
    round(case when count(value) over m = 28 then avg(value) over m end, 6) as rolling_28,
    (isodow(day) - 1)::int as weekday, month(day)::int as month, day(day)::int as day_of_month from ser
    window w as (partition by series order by day), m as (partition by series order by day rows between 34 preceding and 7 preceding)""", _ORD)
def _(spark, sf):
    return rounded(S.lag_features(shop_series(spark, sf)), "value", "lag_7", "lag_14", "lag_21", "lag_28", "rolling_28")


@query("J8_gbt_forecast")
def _(spark, sf):
    return S.gbt_forecast(shop_series(spark, sf))


_BACK = _ORD + """, num as (select *, row_number() over (partition by series order by day) as i, count(*) over (partition by series) as n from ser),
  fo as (select *, n - fold * 28 as cut from num cross join (select unnest(range(1, 5)) as fold)),
  bt as (select t.series as name, t.fold::int as fold, avg(abs((t.value - p.value) / nullif(t.value, 0))) * 100 as mape from fo t
    join fo p on p.series = t.series and p.fold = t.fold and p.i = p.cut - 6 + (t.i - t.cut - 1) % 7
    where t.i > t.cut and t.i <= t.cut + 28 group by 1, 2)"""


@query("J9_rolling_backtest", "select name, fold, 'seasonal_naive' as model, round(mape, 6) as mape from bt", _BACK)
def _(spark, sf):
    return rounded(S.rolling_backtest(shop_series(spark, sf), {"seasonal_naive": S.seasonal_naive}), "mape")


@query("J10_best_model")
def _(spark, sf):
    return S.best_model(S.rolling_backtest(shop_series(spark, sf), S.MODELS))


@query("J9_rolling_backtest_all")
def _(spark, sf):
    return S.rolling_backtest(shop_series(spark, sf), S.MODELS)


@query("J10_mape", "select name, 'seasonal_naive' as best_model, round(avg(mape), 6) as mean_mape from bt group by 1", _BACK)
def _(spark, sf):
    return rounded(S.best_model(S.rolling_backtest(shop_series(spark, sf), {"seasonal_naive": S.seasonal_naive})), "mean_mape")
