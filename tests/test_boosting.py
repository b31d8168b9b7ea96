"""Trees on histograms against MLlib's own."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from shiftscope.operators import boosting, learn as L
from shiftscope.operators.boosting import boost


@pytest.fixture(scope="module")
def rows(spark):
    """Features with zeros, negative numbers, few levels and a constant; a label that depends on them."""
    rng = np.random.default_rng(5)
    n = 3000
    a, b, c = rng.normal(size=n), rng.integers(-3, 9, n).astype(float), np.where(rng.random(n) < 0.6, 0.0, rng.exponential(size=n))
    value = 3 * np.sin(2 * a) + b * (c > 0.3) + c + rng.normal(size=n)
    table = pa.table({"id": np.arange(n), "a": a, "b": b, "c": c, "d": np.full(n, 7.0), "value": value, "late": (value > 2.5).astype(np.int64)})
    frame = spark.createDataFrame(table).withColumn("weight", F.when(F.col("late") == 1, 1.75).otherwise(0.625))
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(frame).repartition(5).cache()


def _close(ours, theirs, col):
    both = [np.array([r[0] for r in df.orderBy("id").select(col).collect()]) for df in (ours, theirs)]
    return float(np.mean(np.abs(both[0] - both[1]) < 1e-9))


@pytest.mark.parametrize("bins", [8, 16])  # with few rows a split, equal gains of two features are told apart by rounding only
def test_classes_as_mllib(rows, bins):
    ours = boost(rows, "late", [0.625, 1.75], True, 10, 0.05, bins).transform(rows)
    theirs = GBTClassifier(labelCol="late", weightCol="weight", maxIter=10, stepSize=0.05, maxBins=bins, seed=0).fit(rows).transform(rows)
    assert _close(ours, theirs, vector_to_array("probability")[1]) > 0.999 and _close(ours, theirs, "prediction") > 0.999


@pytest.mark.parametrize("bins", [32, 300])
def test_numbers_as_mllib(rows, bins):
    ours = boost(rows, "value", [1.0], False, 10, 0.05, bins).transform(rows)
    theirs = GBTRegressor(labelCol="value", maxIter=10, stepSize=0.05, maxBins=bins, seed=0).fit(rows).transform(rows)
    assert _close(ours, theirs, "prediction") > 0.999


def test_every_row_is_counted_in_a_pass_a_level(rows, monkeypatch):
    seen, plain = [], boosting._counted
    monkeypatch.setattr(boosting, "_counted", lambda *a: seen.append(plain(*a)) or seen[-1])
    monkeypatch.setattr(boosting, "BLOCK", 100)
    monkeypatch.setattr(boosting, "SAVED", 2)
    boost(rows, "value", [1.0], False, 6, 0.05, 32)
    # the first feature's bins hold all rows of the root; below, only the smaller child of a node is counted
    assert len(seen) == 6 * boosting.DEPTH and all(s[0][0, 0, :32].sum() == 3000 for s in seen[:: boosting.DEPTH])
    assert all(s[0][:, 0, :32].sum() <= 1500 for i, s in enumerate(seen) if i % boosting.DEPTH)


def _asked(monkeypatch):
    """What ``boost`` is asked for; it makes two trees only."""
    asked = []
    monkeypatch.setattr(L, "boost", lambda data, label, weights, classify, trees, **more: asked.append((label, classify, trees)) or boost(data, label, weights, classify, 2, **more))
    return asked


def test_late_delivery_trains_on_histograms(spark, monkeypatch):
    """MLlib goes over the rows once a level with an object for each; the job has to keep its rounds without it."""
    asked = _asked(monkeypatch)
    late = spark.range(300).select(*[F.rand(i).alias(c) for i, c in enumerate(L.NUMERIC)], *[F.concat(F.lit("x"), F.col("id") % 4).alias(c) for c in L.CATEGORICAL], (F.col("id") % 3 == 0).cast("int").alias("late"), "id")
    assert L.scored(L.late_boosted(late), late, "late", "id").where("score between 0 and 1").count() == 300
    assert asked == [("late", True, 300)]


def test_labels_that_are_missing_are_refused(rows):
    for label, classify in (("late", True), ("value", False)):
        with pytest.raises(ValueError, match="1 of 3000"):
            boost(rows.withColumn(label, F.when(F.col("id") != 7, F.col(label))), label, [1.0, 1.0] if classify else [1.0], classify, 1, 0.05, 8)


def test_no_rows_and_one_row(spark, rows):
    one = rows.where("id = 3")
    model = boost(one, "value", [1.0], False, 3, 0.05, 32)
    assert abs(model.transform(one).first()["prediction"] - one.first()["value"]) < 1e-9
    assert model.transform(one.where("id < 0")).count() == 0
    with pytest.raises(ValueError):
        boost(one.where("id < 0"), "value", [1.0], False, 1, 0.05, 8)


def test_remaining_life_trains_on_histograms(spark, monkeypatch):
    asked = _asked(monkeypatch)
    rul = spark.range(200).select((F.col("id") % 5).alias("unit"), F.col("id").alias("cycle"), F.rand(1).alias("s"), (F.col("id") % 90).alias("rul"))
    assert L.rul_models(rul, rul.where("cycle < 5"), ["s"]).count() == 15 and asked == [("rul", False, 400)]
