"""F: experiments made from the events: arm = hash of the user, one experiment per user segment (user_id mod 3)."""

from __future__ import annotations

import re
from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from checks.change import rounded
from checks.registry import query
from checks.standin import table
from shiftscope.functions.hashing import hash_percent
from shiftscope.operators import experiments as X

_BUCKET = "(('0x' || substr(md5(cast(user_id as varchar)), 1, 8))::bigint & 2147483647) % 100"
_USERS = f"""u as (select user_id % 3 as experiment, user_id, case when {_BUCKET} < 50 then 'control' else 'treatment' end as arm,
    coalesce(sum(case when ts < timestamp '2024-01-16' then value end), 0) as pre_metric,
    coalesce(sum(case when ts >= timestamp '2024-01-16' then value end), 0) as metric,
    max(case when event_type = 'purchase' and value > 20 and ts >= timestamp '2024-01-16' then 1 else 0 end) as converted from events group by user_id)"""


def _tail(x: str, density: str) -> str:
    """Two-sided tail beyond |x| by Simpson's rule over ``density`` (an expression in u)."""
    body = re.sub(r"\bu\b", f"(abs({x}) * i / 4000.0)", density)
    weight = "case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end"
    return f"1 - 2 * abs({x}) / 12000.0 * list_sum(list_transform(range(0, 4001), lambda i: {weight} * {body}))"


_NORMAL = "0.3989422804014327 * (2.718281828459045 ** (-0.5 * u * u))"
_Z = NormalDist().inv_cdf(0.975)
_ZP = NormalDist().inv_cdf(0.8)


def users(spark, sf) -> DataFrame:
    second = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    per_user = table(spark, sf, "events").groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(~second, F.col("value"))), F.lit(0.0)).alias("pre_metric"),
        F.coalesce(F.sum(F.when(second, F.col("value"))), F.lit(0.0)).alias("metric"),
        F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 20) & second, 1).otherwise(0)).alias("converted"))
    return per_user.withColumn("experiment", F.col("user_id") % 3).withColumn(
        "arm", F.when(hash_percent(F.col("user_id")) < 50, "control").otherwise("treatment"))


@query("F1_sample_size", f"""select experiment, round(base, 6) as base, ceil(pow({_Z} * sqrt(2 * (base + base * 1.1) / 2 * (1 - (base + base * 1.1) / 2))
    + {_ZP} * sqrt(base * (1 - base) + base * 1.1 * (1 - base * 1.1)), 2) / pow(base * 1.1 - base, 2))::bigint as users_per_group
    from (select user_id % 3 as experiment, avg(case when event_type = 'purchase' then 1.0 else 0 end) as base from events group by 1)""")
def _(spark, sf):
    is_purchase = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)
    base = table(spark, sf, "events").groupBy((F.col("user_id") % 3).alias("experiment")).agg(F.avg(is_purchase).alias("base"))
    return rounded(X.sample_size(base, "base", 0.1), "base")


@query("F2_split_statistic", """select experiment, n_c, n_t, round(pow(n_c - (n_c + n_t) * 0.5, 2) / ((n_c + n_t) * 0.5) * 2, 6) as chi2 from (
    select experiment, count(*) filter (where arm = 'control') as n_c, count(*) filter (where arm = 'treatment') as n_t from u group by 1)""", _USERS)
def _(spark, sf):
    return rounded(X.split_statistic(users(spark, sf), ["experiment"]), "chi2")


@query("F2_sample_ratio_check", f"""select experiment, n_c, n_t, round(chi2, 6) as chi2, round(p, 6) as p_value, p < 0.001 as mismatch from (select *, {_tail('sqrt(chi2)', _NORMAL)} as p from (
    select *, pow(n_c - (n_c + n_t) * 0.5, 2) / ((n_c + n_t) * 0.5) * 2 as chi2 from (
    select experiment, count(*) filter (where arm = 'control') as n_c, count(*) filter (where arm = 'treatment') as n_t from u group by 1)))""", _USERS)
def _(spark, sf):
    return rounded(X.sample_ratio_check(users(spark, sf), ["experiment"]), "chi2", "p_value")


_PROP = _USERS + f""", pa as (select experiment, count(*) filter (where arm = 'control') as n_c, count(*) filter (where arm = 'treatment') as n_t,
    sum(converted) filter (where arm = 'control')::bigint as conv_c, sum(converted) filter (where arm = 'treatment')::bigint as conv_t from u group by 1),
    pr as (select *, conv_c / n_c::double as rate_control, conv_t / n_t::double as rate_treatment, (conv_c + conv_t) / (n_c + n_t)::double as pool from pa),
    ps as (select *, rate_treatment - rate_control as absolute_lift, (rate_treatment - rate_control) / nullif(rate_control, 0) as relative_lift,
      coalesce((rate_treatment - rate_control) / nullif(sqrt(pool * (1 - pool) * (1.0 / n_c + 1.0 / n_t)), 0), 0) as z,
      {_Z} * sqrt(rate_control * (1 - rate_control) / n_c + rate_treatment * (1 - rate_treatment) / n_t) as margin from pr)"""


@query("F3_proportion_statistic", """select experiment, n_c, n_t, conv_c, conv_t, round(rate_control, 6) as rate_control,
    round(rate_treatment, 6) as rate_treatment, round(absolute_lift, 6) as absolute_lift, round(relative_lift, 6) as relative_lift, round(z, 6) as z,
    round(absolute_lift - margin, 6) as ci_low, round(absolute_lift + margin, 6) as ci_high from ps""", _PROP)
def _(spark, sf):
    out = X.proportion_statistic(users(spark, sf), ["experiment"], F.col("converted"))
    return rounded(out, "rate_control", "rate_treatment", "absolute_lift", "relative_lift", "z", "ci_low", "ci_high")


@query("F3_two_proportion_test", f"""select experiment, round(z, 6) as z, round(p, 6) as p_value, p < 0.05 as significant from (select *, {_tail('z', _NORMAL)} as p from ps)""", _PROP)
def _(spark, sf):
    out = X.two_proportion_test(users(spark, sf), ["experiment"], F.col("converted"))
    return rounded(out.select("experiment", "z", "p_value", "significant"), "p_value", "z")


_CUPED = _USERS + """, th as (select experiment, covar_samp(metric, pre_metric) / var_samp(pre_metric) as theta, avg(pre_metric) as pm from u group by 1),
    adj as (select u.*, theta, metric - theta * (pre_metric - pm) as adjusted from u join th using (experiment))"""


@query("F4_cuped_adjust", "select experiment, user_id, arm, round(theta, 6) as theta, round(adjusted, 4) as adjusted from adj", _CUPED)
def _(spark, sf):
    out = X.cuped_adjust(users(spark, sf), ["experiment"], "metric", "pre_metric").select("experiment", "user_id", "arm", "theta", "adjusted")
    return rounded(rounded(out, "theta"), "adjusted", digits=4)


_WELCH = _CUPED + f""", ws as (select experiment, count(*) filter (where arm = 'control') as n_c, count(*) filter (where arm = 'treatment') as n_t,
      avg(adjusted) filter (where arm = 'control') as mean_c, avg(adjusted) filter (where arm = 'treatment') as mean_t,
      var_samp(adjusted) filter (where arm = 'control') as var_c, var_samp(adjusted) filter (where arm = 'treatment') as var_t from adj group by 1)"""


@query("F5_mean_difference_statistic", f"""select experiment, n_c, n_t, round(mean_t - mean_c, 4) as difference,
    round((mean_t - mean_c) / sqrt(var_c / n_c + var_t / n_t), 6) as t,
    round(pow(var_c / n_c + var_t / n_t, 2) / (pow(var_c / n_c, 2) / (n_c - 1) + pow(var_t / n_t, 2) / (n_t - 1)), 4) as df,
    round(mean_t - mean_c - {_Z} * sqrt(var_c / n_c + var_t / n_t), 4) as ci_low,
    round(mean_t - mean_c + {_Z} * sqrt(var_c / n_c + var_t / n_t), 4) as ci_high from ws""", _WELCH)
def _(spark, sf):
    adjusted = X.cuped_adjust(users(spark, sf), ["experiment"], "metric", "pre_metric")
    out = X.mean_difference_statistic(adjusted, ["experiment"], "adjusted")
    out = out.select("experiment", "n_c", "n_t", "difference", "t", "df", "ci_low", "ci_high")
    return rounded(rounded(out, "t"), "difference", "df", "ci_low", "ci_high", digits=4)


_STUDENT = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * ((1 + u * u / df) ** (-(df + 1) / 2))"


@query("F5_mean_difference_test", f"""select experiment, round(t, 6) as t, round(df, 4) as df, round(p, 6) as p_value, p < 0.05 as significant from (select *, {_tail('t', _STUDENT)} as p from (
    select experiment, (mean_t - mean_c) / sqrt(var_c / n_c + var_t / n_t) as t,
    pow(var_c / n_c + var_t / n_t, 2) / (pow(var_c / n_c, 2) / (n_c - 1) + pow(var_t / n_t, 2) / (n_t - 1)) as df from ws))""", _WELCH)
def _(spark, sf):
    adjusted = X.cuped_adjust(users(spark, sf), ["experiment"], "metric", "pre_metric")
    out = X.mean_difference_test(adjusted, ["experiment"], "adjusted").select("experiment", "t", "df", "p_value", "significant")
    return rounded(rounded(out, "t", "p_value"), "df", digits=4)
