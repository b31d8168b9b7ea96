"""A/B test read-outs for many experiments at once.

Spark reduces the rows to sufficient statistics per experiment and arm; everything after that is arithmetic
on one row per experiment. ``by`` names the experiment columns, ``arm`` is 'control' or 'treatment'.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from shiftscope.functions.numbers import ratio
from shiftscope.functions.probability import normal_two_sided, student_two_sided

SRM_THRESHOLD = 0.001


def _z(p: float) -> float:
    return NormalDist().inv_cdf(p)


def sample_size(baselines: DataFrame, rate: str, lift: float, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Users per group needed to see a relative lift in a rate (two-sided)."""
    p1 = F.col(rate)
    p2 = p1 * (1 + lift)
    mean = (p1 + p2) / 2
    noise = F.lit(_z(1 - alpha / 2)) * F.sqrt(2 * mean * (1 - mean)) + F.lit(_z(power)) * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return baselines.withColumn("users_per_group", F.ceil(ratio(noise * noise, (p2 - p1) * (p2 - p1))))


def _arms(df: DataFrame, by: Sequence[str], **aggs: tuple) -> DataFrame:
    """One row per experiment with <name>_c and <name>_t columns; partial aggregation happens before the shuffle."""
    out = []
    for name, (fn, value) in aggs.items():
        for suffix, arm in (("c", "control"), ("t", "treatment")):
            out.append(fn(F.when(F.col("arm") == arm, value)).alias(f"{name}_{suffix}"))
    return df.groupBy(*by).agg(*out)


def split_statistic(users: DataFrame, by: Sequence[str], expected_share: float = 0.5) -> DataFrame:
    """Chi-square of the observed split against the planned share of the treatment."""
    n = _arms(users, by, n=(F.count, F.lit(1)))
    total = F.col("n_c") + F.col("n_t")
    e_c, e_t = total * (1 - expected_share), total * expected_share
    chi2 = F.pow(F.col("n_c") - e_c, 2) / e_c + F.pow(F.col("n_t") - e_t, 2) / e_t
    return n.withColumn("chi2", chi2)


def sample_ratio_check(users: DataFrame, by: Sequence[str], expected_share: float = 0.5) -> DataFrame:
    """Adds the p-value (1 degree of freedom) and whether the split is broken."""
    stat = split_statistic(users, by, expected_share)
    return stat.withColumn("p_value", normal_two_sided(F.sqrt("chi2"))).withColumn("mismatch", F.col("p_value") < SRM_THRESHOLD)


def proportion_statistic(users: DataFrame, by: Sequence[str], converted: Column, alpha: float = 0.05) -> DataFrame:
    """Rates, lifts, pooled z and unpooled confidence interval."""
    n = _arms(users, by, n=(F.count, F.lit(1)), conv=(F.sum, converted.cast("long")))
    p_c, p_t = ratio(F.col("conv_c"), F.col("n_c")), ratio(F.col("conv_t"), F.col("n_t"))
    rows = n.withColumns({"rate_control": p_c, "rate_treatment": p_t})
    pooled = ratio(F.col("conv_c") + F.col("conv_t"), F.col("n_c") + F.col("n_t"))
    inverse = 1 / F.col("n_c").cast("double") + 1 / F.col("n_t").cast("double")
    diff = F.col("rate_treatment") - F.col("rate_control")
    se_pooled = F.sqrt(pooled * (1 - pooled) * inverse)
    r_c, r_t = F.col("rate_control"), F.col("rate_treatment")
    margin = F.lit(_z(1 - alpha / 2)) * F.sqrt(r_c * (1 - r_c) / F.col("n_c") + r_t * (1 - r_t) / F.col("n_t"))
    return rows.withColumns(
        {
            "absolute_lift": diff, "relative_lift": ratio(diff, r_c),
            "z": F.coalesce(ratio(diff, se_pooled), F.lit(0.0)), "ci_low": diff - margin, "ci_high": diff + margin,
        }
    )


def two_proportion_test(users: DataFrame, by: Sequence[str], converted: Column, alpha: float = 0.05) -> DataFrame:
    stat = proportion_statistic(users, by, converted, alpha)
    return stat.withColumn("p_value", normal_two_sided("z")).withColumn("significant", F.col("p_value") < alpha)


def cuped_adjust(users: DataFrame, by: Sequence[str], metric: str, pre_metric: str) -> DataFrame:
    """Remove what the pre-period explains: metric - theta * (pre - mean(pre)), theta per experiment.

    The two statistics are one row per experiment and joined back, so no experiment is gathered in one task.
    """
    stats = users.groupBy(*by).agg(
        ratio(F.covar_samp(metric, pre_metric), F.var_samp(pre_metric)).alias("theta"), F.avg(pre_metric).alias("pre_mean")
    )
    joined = users.join(stats, list(by))
    adjusted = F.col(metric) - F.col("theta") * (F.col(pre_metric) - F.col("pre_mean"))
    return joined.withColumn("adjusted", adjusted).drop("pre_mean")


def mean_difference_statistic(users: DataFrame, by: Sequence[str], metric: str, alpha: float = 0.05) -> DataFrame:
    """Difference of means, Welch's t and degrees of freedom, normal-quantile interval."""
    m = F.col(metric)
    s = _arms(users, by, n=(F.count, m), mean=(F.avg, m), var=(F.var_samp, m))
    a, b = F.col("var_c") / F.col("n_c"), F.col("var_t") / F.col("n_t")
    diff, se = F.col("mean_t") - F.col("mean_c"), F.sqrt(a + b)
    df = ratio((a + b) * (a + b), a * a / (F.col("n_c") - 1) + b * b / (F.col("n_t") - 1))
    margin = F.lit(_z(1 - alpha / 2)) * se
    return s.withColumns({"difference": diff, "t": ratio(diff, se), "df": df, "ci_low": diff - margin, "ci_high": diff + margin})


def mean_difference_test(users: DataFrame, by: Sequence[str], metric: str, alpha: float = 0.05) -> DataFrame:
    stat = mean_difference_statistic(users, by, metric, alpha)
    return stat.withColumn("p_value", student_two_sided("t", "df")).withColumn("significant", F.col("p_value") < alpha)
