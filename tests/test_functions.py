import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from shiftscope.functions.hashing import hash_percent, hmac_sha256
from shiftscope.functions.ordered import halo_blocks, positions, running_sums
from shiftscope.functions.probability import normal_two_sided, student_two_sided
from shiftscope.functions.quantiles import exact_quantile


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))  # one hot key
    return spark.createDataFrame([(int(k), int(i), float(v)) for i, (k, v) in enumerate(zip(key, rng.integers(0, 50, n)))], "k int, i int, v double")


@pytest.mark.parametrize("descending", [False, True])
def test_sliced_positions_equal_a_plain_window(rows, descending):
    order = F.col("v").desc() if descending else F.col("v").asc()
    want = rows.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(order, "i")))
    got = positions(rows, ["k"], "v", ["i"], descending=descending)
    assert got.select("k", "i", "pos").exceptAll(want.select("k", "i", F.col("pos").cast("bigint"))).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_positions_with_nulls_texts_and_ties(spark, descending):
    values = [None, "b", "a", None, "c", "a", "a", None, "b", ""] * 30
    rows = spark.createDataFrame([(None if i % 3 == 0 else i % 2, v, i) for i, v in enumerate(values)], "k int, v string, i int")
    order = F.col("v").desc() if descending else F.col("v").asc()
    want = rows.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(order, "i")).cast("bigint"))
    got = positions(rows, ["k"], "v", ["i"], descending=descending)
    assert got.select("k", "i", "pos").exceptAll(want.select("k", "i", "pos")).count() == 0 and got.count() == len(values)


def test_sliced_running_sums_without_a_group(rows):
    want = rows.select("i", F.sum("v").over(Window.orderBy("v", "i").rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    got = running_sums(rows, [], "v", {"s": F.col("v")}, ["i"]).select("i", "s")
    assert got.exceptAll(want).count() == 0 and got.count() == rows.count()


def test_halo_blocks_keep_every_row_once(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "pos")
    out = halo_blocks(df, "pos", 5, 16)
    assert out.where("not _halo").count() == 100
    assert out.where("_halo").count() == 6 * 5  # the last block is not followed by another full one
    with pytest.raises(ValueError):
        halo_blocks(df, "pos", 16, 16)


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, q):
    v = np.random.default_rng(4).lognormal(size=4001)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    assert exact_quantile(df, "x", q) == pytest.approx(np.quantile(v, q), rel=1e-12)


def test_hmac_equals_the_standard(spark):
    for secret in ("short", "x" * 100):
        got = spark.createDataFrame([("{\"a\": \"é\"}",)], "b string").select(hmac_sha256(F.col("b"), secret)).first()[0]
        assert got == hmac.new(secret.encode(), "{\"a\": \"é\"}".encode(), hashlib.sha256).hexdigest()


def test_hash_percent(spark):
    got = spark.createDataFrame([("abc",)], "b string").select(hash_percent(F.col("b"))).first()[0]
    assert got == (int(hashlib.md5(b"abc").hexdigest()[:8], 16) & 0x7FFFFFFF) % 100


def test_tail_probabilities(spark):
    df = spark.createDataFrame([(1.959963985, 10.0, 2.228138852), (0.0, 3.0, 3.182446305)], "z double, df double, t double")
    a, b = df.select(normal_two_sided("z").alias("n"), student_two_sided("t", "df").alias("s")).collect()
    assert a.n == pytest.approx(0.05, abs=1e-9) and b.n == pytest.approx(1.0)
    assert a.s == pytest.approx(0.05, abs=1e-8) and b.s == pytest.approx(0.05, abs=1e-8)
