"""The model queries train as long as the reference does."""

import inspect

from checks import learn as queries
from checks.learn import _late_sets
from checks.standin import shop
from shiftscope.operators import learn as L


def test_rounds_of_the_reference():
    rounds = lambda f: inspect.signature(f).parameters["trees"].default
    assert rounds(L.late_boosted) == 300 and rounds(L.rul_models) == 400
    source = inspect.getsource(queries)
    assert "trees=" not in source and "bits=" not in source


def test_training_rows_use_all_cores(spark, sf):
    """The rows of J13 and J14 are narrow, so that a scan has few splits; each pass over them has to use all cores."""
    train, test = _late_sets(spark, sf)
    assert train.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    both = train.drop("split").unionByName(test.drop("split"))
    assert both.count() == L.late_features(shop(spark, sf)).count() and both.select("row_key").distinct().count() == both.count()
    few = train.coalesce(1).cache()
    same = [L.scored(L.late_boosted(rows, trees=2), few, "late", "row_key").groupBy().agg({"score": "sum"}).first()[0] for rows in (few, train)]
    assert abs(same[0] - same[1]) < 1e-6 * abs(same[0])
