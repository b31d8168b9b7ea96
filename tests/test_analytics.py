import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftscope.operators import experiments as X, series as S


def test_sample_size_textbook(spark):
    df = spark.createDataFrame([(0.1,)], "p double")
    assert 14_500 < X.sample_size(df, "p", 0.1).first()["users_per_group"] < 15_000


def _users(spark, rng, lift=0.0, n=4000):
    pre = rng.normal(100, 20, n)
    arm = np.where(np.arange(n) % 2 == 0, "control", "treatment")
    post = 0.8 * pre + rng.normal(0, 5, n) + np.where(arm == "treatment", lift, 0)
    return spark.createDataFrame(pd.DataFrame({"e": "x", "arm": arm, "pre": pre, "post": post, "conv": (rng.random(n) < np.where(arm == "treatment", 0.15, 0.1))}))


def test_cuped_keeps_the_mean_and_cuts_the_variance(spark):
    users = _users(spark, np.random.default_rng(0))
    r = X.cuped_adjust(users, ["e"], "post", "pre").agg(F.avg("post"), F.avg("adjusted"), F.variance("post"), F.variance("adjusted")).first()
    assert r[1] == pytest.approx(r[0]) and r[3] < 0.2 * r[2]


def test_differences_are_found(spark):
    users = _users(spark, np.random.default_rng(1), lift=2.0)
    assert X.mean_difference_test(users, ["e"], "post").first()["significant"]
    assert X.two_proportion_test(users, ["e"], F.col("conv")).first()["significant"]
    assert not X.sample_ratio_check(users, ["e"]).first()["mismatch"]
    broken = users.where("arm = 'control' or pre > 100")
    assert X.sample_ratio_check(broken, ["e"]).first()["mismatch"]


@pytest.fixture(scope="module")
def weekly(spark):
    days = pd.date_range("2024-01-01", periods=180)
    rng = np.random.default_rng(0)
    base = np.array([100, 120, 130, 125, 140, 90, 80])[np.arange(180) % 7] + 0.1 * np.arange(180) + rng.normal(0, 3, 180)
    spike = base.copy()
    spike[100] += 80
    frame = pd.DataFrame({"series": ["flat"] * 180 + ["spike"] * 180, "day": list(days.date) * 2, "value": np.concatenate([base, spike])})
    return spark.createDataFrame(frame, "series string, day date, value double")


def test_planted_spike_is_the_only_anomaly(weekly):
    parts = S.seasonal_decompose(weekly).toPandas()
    assert np.allclose(parts["trend"] + parts["seasonal"] + parts["resid"], parts["value"])
    found = S.robust_anomalies(S.seasonal_decompose(weekly)).collect()
    assert [(r.series, str(r.day)) for r in found] == [("spike", "2024-04-10")]


def test_holt_winters_beats_the_mean_and_naive_fits_the_week(spark, weekly):
    flat = lambda train, horizon: train.groupBy("series").agg(F.avg("value").alias("prediction")).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    scores = S.rolling_backtest(weekly.where("series = 'flat'"), {"flat": flat, "holt_winters": S.holt_winters, "seasonal_naive": S.seasonal_naive})
    mean = {r.model: r.m for r in scores.groupBy("model").agg(F.avg("mape").alias("m")).collect()}
    assert mean["holt_winters"] < mean["flat"] and mean["holt_winters"] < 6
    assert S.best_model(scores).first()["best_model"] in ("holt_winters", "seasonal_naive")


def test_gaps_are_filled(spark):
    rows = spark.createDataFrame([("a", "2024-01-02", None), ("a", "2024-01-03", 2.0), ("a", "2024-01-06", 8.0), ("a", "2024-01-07", None)], "series string, day string, value double")
    out = S.fill_days(rows.withColumn("day", F.col("day").cast("date"))).orderBy("day").collect()
    assert [r.value for r in out] == [None, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_short_series_have_no_forecast_and_do_not_stop_the_others(spark, weekly):
    short = spark.createDataFrame([("short", f"2024-01-0{d}", 1.0) for d in range(1, 6)], "series string, day string, value double").withColumn("day", F.col("day").cast("date"))
    for model in (S.holt_winters, lambda t: S.gbt_forecast(t, trees=5)):
        out = model(weekly.where("series = 'flat'").unionByName(short)).toPandas()
        assert out[out.series == "short"].prediction.isna().all() and out[out.series == "flat"].prediction.notna().all()


def test_forecasts_do_not_know_later_days_or_other_series(weekly):
    late = weekly.withColumn("value", F.col("value") + F.when(F.col("day") > "2024-06-01", 500.0).otherwise(0.0))
    model = lambda train, horizon: S.gbt_forecast(train, horizon, trees=20)

    def forecasts(rows):
        parts = S.backtest_rows(rows, folds=4)
        train = parts.where("step is null and fold = 4")
        return {(r.series, r.step): r.prediction for r in model(train, 28).collect()}

    assert forecasts(weekly) == forecasts(late)


def test_boosting_beats_the_mean_on_days_held_out(weekly):
    flat = weekly.where("series = 'flat'")
    level = lambda train, horizon: train.groupBy("series").agg(F.avg("value").alias("prediction")).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    scores = S.rolling_backtest(flat, {"boosted": lambda t, h: S.gbt_forecast(t, h, trees=100), "seasonal_naive": S.seasonal_naive, "mean": level})
    mean = {r.model: r.m for r in scores.groupBy("model").agg(F.avg("mape").alias("m")).collect()}
    assert mean["boosted"] < 12 and mean["boosted"] < mean["mean"] and S.best_model(scores).count() == 1


def test_block_forecast_uses_only_known_lags(weekly):
    out = S.gbt_forecast(weekly.where("series = 'flat'"), trees=5)
    assert sorted(r.step for r in out.collect()) == list(range(1, 29))
