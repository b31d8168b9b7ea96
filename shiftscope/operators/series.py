"""Daily series for many keys at once: gaps, seasonality, anomalies, forecasts and backtests.

A series has one row per (key, day) after aggregation, so the per-key windows below are bounded by the number
of days, whatever the number of raw rows.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shiftscope.functions.numbers import ratio
from shiftscope.session import cut_lineage

HORIZON = 28
TREES = 300
SEASON = 7
THRESHOLD = 6.0
MAD_SCALE = 0.6745  # makes the median absolute deviation comparable to a standard deviation
LAGS = (7, 14, 21, 28)


# ---------------------------------------------------------------- building series
def daily_values(rows: DataFrame, keys: Column, ts: str, value: Column) -> DataFrame:
    """(series, day, value): one aggregate per key and calendar day."""
    return rows.groupBy(keys.cast("string").alias("series"), F.to_date(ts).alias("day")).agg(value.cast("double").alias("value"))


def order_series(orders: DataFrame, start: str, end: str) -> DataFrame:
    """The three shop series: orders, canceled_rate, late_rate per purchase day, in one pass."""
    at = F.col("order_purchase_timestamp")
    rows = orders.where((at >= F.lit(start).cast("date")) & (at < F.lit(end).cast("date")))
    done = (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    late = (F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")).cast("int")
    daily = rows.groupBy(F.to_date(at).alias("day")).agg(
        F.count("*").cast("double").alias("orders"),
        F.avg(F.when(F.col("order_status") == "canceled", 1.0).otherwise(0.0)).alias("canceled_rate"),
        F.avg(F.when(done, late)).alias("late_rate"),
    )
    return daily.unpivot(["day"], ["orders", "canceled_rate", "late_rate"], "series", "value").select("series", "day", "value")


def fill_days(values: DataFrame) -> DataFrame:
    """Every day between the first and last of a series; inner gaps linear, leading gap NULL, trailing gap carried."""
    span = values.groupBy("series").agg(F.min("day").alias("a"), F.max("day").alias("z"))
    spine = span.select("series", F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("day"))
    rows = spine.join(values, ["series", "day"], "left")
    back = Window.partitionBy("series").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("series").orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.struct("day", "value"))
    rows = rows.withColumns({"p": F.last(known, True).over(back), "n": F.first(known, True).over(ahead)})
    share = ratio(F.date_diff(F.col("day"), F.col("p.day")), F.date_diff(F.col("n.day"), F.col("p.day")))
    between = F.col("p.value") + (F.col("n.value") - F.col("p.value")) * share
    return rows.select("series", "day", F.coalesce("value", between, F.col("p.value")).alias("value"))


# ---------------------------------------------------------------- decomposition
def seasonal_residual(series: DataFrame) -> DataFrame:
    """Trend = centred 7-day mean, seasonal = median weekday effect, residual = rest."""
    centred = Window.partitionBy("series").orderBy("day").rowsBetween(-3, 3)
    rows = series.withColumn("trend", F.avg("value").over(centred)).withColumn("weekday", F.weekday("day"))
    effect = rows.groupBy("series", "weekday").agg(F.median(F.col("value") - F.col("trend")).alias("seasonal"))
    out = rows.join(effect, ["series", "weekday"])
    return out.select("series", "day", "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("resid"))


def _loess(y: np.ndarray, span: int, at: np.ndarray, robust: np.ndarray) -> np.ndarray:
    """Local linear fit with tricube weights at positions ``at`` of a unit-spaced series."""
    n = len(y)
    x = np.arange(n, dtype=float)
    q = min(span, n)
    left = np.clip(np.round(at).astype(int) - q // 2, 0, n - q)
    cols = left[:, None] + np.arange(q)[None, :]
    dist = np.abs(x[cols] - at[:, None])
    reach = dist.max(axis=1) + (max(span - n, 0) // 2)
    w = np.clip(1 - (dist / np.maximum(reach, 1e-12)[:, None]) ** 3, 0, None) ** 3 * robust[cols]
    total = w.sum(axis=1)
    w = np.where(total[:, None] > 0, w / np.where(total > 0, total, 1)[:, None], 1.0 / q)
    mean_x = (w * x[cols]).sum(axis=1)
    mean_y = (w * y[cols]).sum(axis=1)
    var = (w * (x[cols] - mean_x[:, None]) ** 2).sum(axis=1)
    cov = (w * (x[cols] - mean_x[:, None]) * y[cols]).sum(axis=1)
    return mean_y + np.where(var > 1e-9, cov / np.where(var > 1e-9, var, 1), 0.0) * (at - mean_x)


def _average(v: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(v, np.ones(k) / k, mode="valid")


def stl(y: np.ndarray, period: int = SEASON, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal part by robust STL (Cleveland et al., 1990)."""
    n = len(y)
    trend_span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    low_span = (period + 1) | 1
    weights, trend, season = np.ones(n), np.zeros(n), np.zeros(n)
    grid = np.arange(n, dtype=float)
    for _ in range(outer):
        for _ in range(inner):
            detrended, cycle = y - trend, np.empty(n + 2 * period)
            for k in range(period):
                part = detrended[k::period]
                cycle[k::period] = _loess(part, seasonal, np.arange(-1, len(part) + 1, dtype=float), weights[k::period])
            low = _average(_average(_average(cycle, period), period), 3)
            season = cycle[period : period + n] - _loess(low, low_span, grid, np.ones(n))
            trend = _loess(y - season, trend_span, grid, weights)
        left = np.abs(y - trend - season)
        scale = 6 * np.median(left)
        weights = np.clip(1 - (left / scale) ** 2, 0, None) ** 2 if scale > 0 else np.ones(n)
    return trend, season


def seasonal_decompose(series: DataFrame) -> DataFrame:
    """Robust STL of every series; a series needs two full weeks."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        y = pdf["value"].to_numpy(dtype=float)
        ok = np.isfinite(y)
        pdf = pdf.assign(trend=np.nan, seasonal=np.nan)
        if ok.sum() >= 2 * SEASON:
            trend, season = stl(y[ok])
            pdf.loc[ok, "trend"], pdf.loc[ok, "seasonal"] = trend, season
        return pdf.assign(resid=pdf["value"] - pdf["trend"] - pdf["seasonal"])

    schema = "series string, day date, value double, trend double, seasonal double, resid double"
    out = series.select("series", "day", "value").groupBy("series").applyInPandas(one, schema)
    return out.select("series", "day", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("value", "trend", "seasonal", "resid")])


def robust_anomalies(parts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Days whose residual is far from the median of its series, measured in median absolute deviations."""
    centre = parts.groupBy("series").agg(F.median("resid").alias("mid"))
    rows = parts.join(centre, "series")
    spread = rows.groupBy("series").agg(F.median(F.abs(F.col("resid") - F.col("mid"))).alias("mad"))
    mad = F.when(F.col("mad") == 0, F.lit(1e-9)).otherwise(F.col("mad"))
    z = F.lit(MAD_SCALE) * (F.col("resid") - F.col("mid")) / mad
    return (
        rows.join(spread, "series").withColumn("z", z).where(F.abs("z") >= threshold)
        .select("series", "day", F.round("value", 4).alias("value"), F.round(F.col("trend") + F.col("seasonal"), 4).alias("expected"),
                F.round("z", 2).alias("robust_z"))
        .orderBy(F.abs("robust_z").desc(), "series", "day")
    )


# ---------------------------------------------------------------- forecasts: (series, day, value) -> (series, step, prediction)
def seasonal_naive(train: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Same weekday of the last observed week."""
    newest = Window.partitionBy("series").orderBy(F.col("day").desc())
    last = train.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= SEASON)
    steps = F.filter(F.sequence(F.lit(1), F.lit(horizon)), lambda i: (i - 1) % SEASON == SEASON - F.col("age"))
    return last.select("series", F.explode(steps).alias("step"), F.col("value").alias("prediction"))


GRID = {  # coarse grid of level, slope and season rates and damping; the finer one spans half a step or so around its best point
    "a": ([round(0.05 + 0.15 * i, 2) for i in range(7)], 0.1, 0.01, 0.99),
    "b": ([0.0, 0.2, 0.4, 0.6], 0.1, 0.0, 0.99),
    "g": ([0.0, 0.15, 0.3, 0.45, 0.6], 0.1, 0.0, 0.99),
    "p": ([0.8, 0.9, 0.98], 0.03, 0.8, 0.995),
}
_SEASONS = [f"s{i}" for i in range(SEASON)]


def _smoothed(values: Column, a: Column, b: Column, g: Column, p: Column) -> Column:
    """sse, level, slope and the next seven seasonal effects (s0 is next) after damped additive Holt-Winters over ``values``."""
    first, second = (F.aggregate(F.slice(values, 1 + SEASON * i, SEASON), F.lit(0.0), lambda s, y: s + y) / SEASON for i in (0, 1))
    start = F.struct(F.lit(0.0).alias("sse"), first.alias("level"), ((second - first) / SEASON).alias("slope"), *[(F.get(values, F.lit(i)) - first).alias(n) for i, n in enumerate(_SEASONS)])

    def step(x: Column, y: Column) -> Column:
        ahead = x["level"] + p * x["slope"]
        miss = y - (ahead + x["s0"])
        # the effect just used comes round again in a week
        queue = [*[x[n] for n in _SEASONS[1:]], x["s0"] + g * miss]
        return F.struct((x["sse"] + miss * miss).alias("sse"), (ahead + a * miss).alias("level"), (p * x["slope"] + b * (a * miss)).alias("slope"), *[q.alias(n) for q, n in zip(queue, _SEASONS)])

    return F.aggregate(values, start, step)


def _best_fit(tried: DataFrame) -> DataFrame:
    """The parameters of least squared error of every series (ties: the smallest), with the state they end in."""
    names = list(GRID)
    fit = _smoothed(F.col("values"), *[F.col(n) for n in names])
    rows = tried.withColumn("fit", fit).select("series", F.struct(F.col("fit.sse").alias("sse"), *names).alias("by"), "fit")
    return rows.groupBy("series").agg(F.min_by(F.struct("by", "fit"), "by").alias("best")).select("series", "best.*")


def fitted_smoothing(train: DataFrame) -> DataFrame:
    """(series, by: sse and the parameters a, b, g, p, fit: final state) of every series of two weeks and more.

    The parameter grid is rows: all series and all parameters are smoothed side by side, each by one fold over its days. A series is one array.
    """
    known = train.where("value is not null").groupBy("series").agg(F.sort_array(F.collect_list(F.struct("day", "value"))).alias("rows"))
    series = cut_lineage(known.where(F.size("rows") >= 2 * SEASON).select("series", F.col("rows.value").alias("values")))
    tried = series
    for name, (values, *_) in GRID.items():
        tried = tried.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    coarse = cut_lineage(_best_fit(tried.repartition("series", *GRID)))
    tried = series.join(coarse.select(F.col("series").alias("of"), "by"), F.col("series").eqNullSafe(F.col("of"))).drop("of")
    for name, (_, w, low, high) in GRID.items():
        near = [F.least(F.greatest(F.col(f"by.{name}") + w * k, F.lit(low)), F.lit(high)) for k in (-1.0, -0.5, 0.0, 0.5, 1.0)]
        tried = tried.withColumn(name, F.explode(F.array_distinct(F.array(*near))))
    return _best_fit(tried.drop("by").repartition("series", *GRID))


def holt_winters(train: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """(series, step, prediction): exponential smoothing with damped trend and weekly season, fitted per series by grid search.

    A series of under two weeks has no forecast, which is rows without a value.
    """
    fits = fitted_smoothing(train).select(F.col("series").alias("of"), "by", "fit")
    rows = train.select("series").distinct().join(fits, F.col("series").eqNullSafe(F.col("of")), "left")
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    damped = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0.0), lambda s, k: s + F.pow(F.col("by.p"), k))
    season = F.get(F.array(*[F.col(f"fit.{n}") for n in _SEASONS]), (F.col("step") - 1) % SEASON)
    return rows.select("series", "step", (F.col("fit.level") + F.col("fit.slope") * damped + season).alias("prediction"))


def lag_features(series: DataFrame) -> DataFrame:
    """Lags, the mean of 28 values ending a week ago (NULL unless all are there), and calendar features."""
    by_day = Window.partitionBy("series").orderBy("day")
    month = by_day.rowsBetween(-(SEASON + 27), -SEASON)
    cols = {f"lag_{k}": F.lag("value", k).over(by_day) for k in LAGS}
    cols["rolling_28"] = F.when(F.count("value").over(month) == 28, F.avg("value").over(month))
    cols |= {"weekday": F.weekday("day"), "month": F.month("day"), "day_of_month": F.dayofmonth("day")}
    return series.withColumns(cols)


FEATURES = [*[f"lag_{k}" for k in LAGS], "rolling_28", "weekday", "month", "day_of_month"]


def _days_after(tail: list[tuple], predicted: list[float], count: int) -> list[tuple]:
    """(day, value) of what is known, what is predicted, and ``count`` days without a value."""
    last = tail[-1][0]
    return [*tail, *[(last + timedelta(days=i + 1), v) for i, v in enumerate([*predicted, *[None] * count])]]


def _forecast_one(spark: SparkSession, rows: DataFrame, tail: list[tuple], horizon: int, trees: int) -> list[float | None]:
    """The forecast of one series from its feature rows and its last days."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip")
    held = F.col("day") > F.lit(tail[-1][0] - timedelta(days=HORIZON))
    fit_on = assembler.transform(rows.where("value is not null")).select("features", F.col("value").alias("label"), held.alias("held")).coalesce(1).persist()
    try:
        days = fit_on.agg(F.count_if(~F.col("held")).alias("n"), F.count("*").alias("all")).first()
        if days["all"] < SEASON:
            return [None] * horizon
        learner = GBTRegressor(maxIter=trees, stepSize=0.05, maxDepth=3, seed=0, checkpointInterval=50, validationTol=0.001)
        # where there is enough to hold the last weeks back, rounds end once these are met no better
        model = (learner.setValidationIndicatorCol("held") if HORIZON < days["n"] < days["all"] else learner).fit(fit_on)
    finally:
        fit_on.unpersist()
    ahead: list[float | None] = []
    while len(ahead) < horizon:  # the shortest lag is a week, so a week is predicted at once and fed back
        count = min(SEASON, horizon - len(ahead))
        frame = spark.createDataFrame([("", *r) for r in _days_after(tail, ahead, count)], "series string, day date, value double").coalesce(1)
        new = assembler.transform(lag_features(frame).orderBy(F.desc("day")).limit(count))
        known = {r.day: r.prediction for r in model.transform(new).select("day", "prediction").collect()}
        ahead += [known.get(tail[-1][0] + timedelta(days=len(ahead) + i + 1)) for i in range(count)]
    return ahead


def gbt_forecast(train: DataFrame, horizon: int = HORIZON, trees: int = TREES, parallel: int = 8) -> DataFrame:
    """Boosted trees on lag features, one model for each series, so no forecast knows days or levels of another.

    Models are trained by Spark ML, ``parallel`` of them at a time, for ``trees`` rounds at most: they end when the last four weeks of what is known
    improve by less than a thousandth. A series whose days don't fill the features has NULL forecasts. The driver knows
    the names of the series, their last 70 days and their forecasts: this is for series worth a model each, not for millions of them.
    """
    spark = train.sparkSession
    rows = cut_lineage(lag_features(train.select("series", "day", "value")))
    newest = Window.partitionBy("series").orderBy(F.desc("day"))
    last = rows.withColumn("age", F.row_number().over(newest)).where("age <= 70").select("series", "day", "value").orderBy("series", "day").collect()
    tails: dict = {}
    for r in last:
        tails.setdefault(r.series, []).append((r.day, r.value))

    def one(name) -> list[tuple]:
        ahead = _forecast_one(spark, rows.where(F.col("series").eqNullSafe(F.lit(name))), tails[name], horizon, trees)
        return [(name, i + 1, v) for i, v in enumerate(ahead)]

    with ThreadPoolExecutor(parallel) as pool:
        found = [r for part in pool.map(inheritable_thread_target(spark)(one), tails) for r in part]
    return spark.createDataFrame(found, "series string, step int, prediction double")


MODELS: dict[str, Callable[..., DataFrame]] = {
    "seasonal_naive": seasonal_naive,
    "holt_winters": holt_winters,
    "gradient_boosting": gbt_forecast,
}


# ---------------------------------------------------------------- backtest
def backtest_rows(series: DataFrame, folds: int = 4, horizon: int = HORIZON) -> DataFrame:
    """Unfold each row into the folds it belongs to: ``step`` is NULL in training, 1..horizon in the test part."""
    counted = Window.partitionBy("series")
    rows = series.withColumns({"i": F.row_number().over(counted.orderBy("day")), "n": F.count("*").over(counted)})
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    cut = F.col("n") - F.col("fold") * horizon
    step = F.when(F.col("i") > cut, F.col("i") - cut).cast("int")
    rows = rows.where((cut > 0) & (F.col("i") <= cut + horizon))
    key = F.concat_ws("#", F.col("series"), F.col("fold").cast("string"))
    return rows.select(key.alias("series"), F.col("series").alias("name"), "fold", "day", "value", step.alias("step"))


def rolling_backtest(series: DataFrame, models: dict[str, Callable[..., DataFrame]], folds: int = 4, horizon: int = HORIZON) -> DataFrame:
    """MAPE of every model, series and fold, NULL where the model has no forecast for some day; all folds run in the same job."""
    rows = backtest_rows(series, folds, horizon)
    train, test = rows.where("step is null").select("series", "day", "value"), rows.where("step is not null")
    out = None
    for name, model in models.items():
        joined = test.join(model(train, horizon), ["series", "step"], "left")
        part = mape(joined, "value", "prediction", ["name", "fold"]).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def mape(df: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """Mean absolute percentage error per group, NULL if a prediction is missing; a zero actual value has no percentage."""
    error = F.abs(ratio(F.col(actual) - F.col(predicted), F.col(actual)))
    return df.groupBy(*by).agg(F.when(F.count_if(F.col(predicted).isNull()) == 0, F.avg(error) * 100).alias("mape"))


def best_model(scores: DataFrame) -> DataFrame:
    """Mean MAPE per model and the best model of every series, over the folds that all models have a value for."""
    models = scores.select("model").distinct().agg(F.count("*").alias("n")).select("n").scalar()
    shared = scores.where(F.col("mape").isNotNull()).groupBy("name", "fold").agg(F.count("*").alias("n")).where(F.col("n") == models).select("name", "fold")
    mean = scores.join(shared, ["name", "fold"]).groupBy("name", "model").agg(F.avg("mape").alias("mean_mape"))
    return mean.groupBy("name").agg(F.min_by("model", F.struct("mean_mape", "model")).alias("best_model"), F.min("mean_mape").alias("mean_mape"))
