"""Keyed state in streams: restarts, very large keys, and what a landing batch reads."""

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks.streams import _in_parts
from shiftscope.operators import events as E, sensors as S
from shiftscope.session import scratch_path, shared_dir
from shiftscope.streaming import events as SE, keyed, sensors as SS
from shiftscope.streaming.keyed import in_order
from shiftscope.streaming.sources import SENSOR_SCHEMA, file_stream, run_to_table, write_batches


class _Map:
    """A map state in memory that remembers how much it held."""

    def __init__(self):
        self.held, self.most = {}, 0

    def updateValue(self, key, value):
        self.held[key] = value
        self.most = max(self.most, len(self.held))

    def getValue(self, key):
        return self.held[key]

    def clear(self):
        self.held = {}


def test_rows_of_a_key_come_in_order():
    rng = np.random.default_rng(0)
    t = rng.permutation(5000)
    frames = [pd.DataFrame({"t": part, "x": part * 2}) for part in np.array_split(t, 13)]
    staged = _Map()
    out = list(in_order(iter(frames), "t", staged, width=100))
    assert [len(f) for f in out] == [100] * 50 and pd.concat(out)["t"].tolist() == list(range(5000)) and (pd.concat(out).x == 2 * pd.concat(out).t).all()
    assert staged.most > 0 and staged.held == {}
    assert [len(f) for f in in_order(iter(frames[:1]), "t", staged)] == [len(frames[0])] and list(in_order(iter([]), "t", staged)) == []


def _feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_monitor_goes_on_after_a_restart(spark):
    """State comes back from the checkpoint: two runs of a stream give what one batch over all readings gives."""
    rng = np.random.default_rng(1)
    rows = [(m, t, float(2 + 0.03 * t * (m == "worn") + rng.normal(0, 0.5))) for m in ("worn", "healthy") for t in range(400)]
    src, out, state = (scratch_path(spark, n) for n in ("readings", "monitor", "state"))
    for low, high in ((0, 150), (150, 151), (151, 400)):
        _feed(spark, src, [r for r in rows if low <= r[1] < high], SENSOR_SCHEMA)
        write_batches(SS.monitor_stream(file_stream(spark, src, SENSOR_SCHEMA), threshold=7.0), out, state, "append").awaitTermination()
    got = {(r.machine_id, r.t): r for r in spark.read.parquet(out).collect()}
    want = {(r.machine_id, r.t): r for r in S.kalman_monitor(spark.createDataFrame(rows, SENSOR_SCHEMA)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k].level - want[k].level) < 1e-9 and abs(got[k].slope - want[k].slope) < 1e-9 for k in want)
    alerts = {r.machine_id: r.at_step for r in S.failure_alerts(spark.createDataFrame(list(want.values())), 7.0).collect()}
    assert {k[0]: k[1] for k, r in got.items() if r.alert} == alerts


def test_a_very_large_key_in_one_batch(spark):
    """100,000 readings of one machine in one micro-batch come in frames and in any order."""
    n = 100_000
    rows = spark.range(n).select(F.lit("m").alias("machine_id"), (F.col("id") * 7919 % n).alias("t"), (F.hash("id") % 100 / 10.0).alias("value"))
    src = scratch_path(spark, "readings")
    rows.coalesce(1).write.parquet(src)
    out = scratch_path(spark, "monitor")
    write_batches(SS.monitor_stream(file_stream(spark, src, SENSOR_SCHEMA)), out, scratch_path(spark, "state"), "append").awaitTermination()
    both = spark.read.parquet(out).join(S.kalman_monitor(rows).select("t", F.col("level").alias("l"), F.col("slope").alias("s")), "t")
    assert both.count() == n and both.agg(F.max(F.abs(F.col("level") - F.col("l")) + F.abs(F.col("slope") - F.col("s")))).first()[0] < 1e-9


EVENT = "arrival bigint, provider string, event_id string, event_type string, order_id string, occurred_at timestamp, amount bigint"


def test_orders_go_on_after_a_restart(spark):
    rng = np.random.default_rng(2)
    kinds = ["payment.authorized", "payment.captured", "payment.failed", "payment.other"]
    rows = []
    for i in range(600):
        pay, at = bool(rng.integers(0, 2)), None if rng.random() < 0.1 else datetime(2024, 1, 1, int(rng.integers(0, 24)), int(rng.integers(0, 60)))
        rows.append((i, "razorpay" if pay else "shiprocket", f"e{i}", str(rng.choice(kinds)) if pay else f"shipment.s{rng.integers(0, 4)}", f"o{rng.integers(0, 9)}", at, int(rng.integers(0, 99)) if pay else None))
    src, out, state = (scratch_path(spark, n) for n in ("events", "orders", "state"))
    for low, high in ((0, 200), (200, 600)):
        _feed(spark, src, rows[low:high][::-1], EVENT)
        write_batches(SE.order_state_stream(file_stream(spark, src, EVENT)), out, state).awaitTermination()
    newest = {}
    for r in spark.read.parquet(out).orderBy("batch").collect():
        newest[r.order_id] = tuple(r)[:6]
    assert newest == {r.order_id: tuple(r) for r in E.order_state(spark.createDataFrame(rows, EVENT)).collect()}


def test_a_batch_with_one_event_reads_one_bucket(spark):
    src, landed, state = (scratch_path(spark, n) for n in ("messages", "landed", "state"))
    rows = [(i, "razorpay", f"e{i}", "payment.captured", "o", datetime(2024, 1, 1), i) for i in range(500)]
    land = lambda: SE.land_events(file_stream(spark, src, EVENT), landed, state, buckets=16).awaitTermination()
    _feed(spark, src, rows, EVENT)
    land()
    assert SE.landed_events(spark, landed).select("bucket").distinct().count() == 16
    _feed(spark, src, [(900, "razorpay", "e7", "payment.captured", "o", datetime(2024, 1, 2), 1), (901, "razorpay", "new", "payment.captured", "o", datetime(2024, 1, 2), 1)], EVENT)
    land()
    held = SE.landed_events(spark, landed)
    assert held.count() == 501 and {r.event_id for r in held.where("batch = 1").collect()} == {"new"}
    # the files a batch of one event would read are those of its bucket
    bucket = spark.createDataFrame([("razorpay", "e7")], "provider string, event_id string").select(SE.bucket_of(16)).first()[0]
    plan = held.where(F.col("bucket").isin([bucket]) & (F.col("batch") != 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    seen = held.where(F.col("bucket").isin([bucket]) & (F.col("batch") != 2)).select(F.input_file_name().alias("f")).distinct().collect()
    assert seen and all(f"bucket={bucket}/" in r.f for r in seen)


def test_a_delivery_is_many_files_and_one_batch(spark):
    rows = spark.range(0, 9000, 1, 8).selectExpr("id * 7919 % 9000 as arrival", "id as v")
    stream, deliveries = _in_parts(rows, "arrival", "dealt")
    out, state = scratch_path(spark, "dealt-out"), scratch_path(spark, "dealt-state")
    for _ in deliveries:
        write_batches(stream, out, state, "append").awaitTermination()
    seen = spark.read.parquet(out).groupBy("batch").agg(F.min("arrival"), F.max("arrival"), F.count("*")).orderBy("batch").collect()
    assert [tuple(r)[1:] for r in seen] == [(0, 2999, 3000), (3000, 5999, 3000), (6000, 8999, 3000)]
    assert len(spark.read.parquet(f"{shared_dir(spark)}/dealt-*/part-*").inputFiles()) > 6
    none, deliveries = _in_parts(rows.where("v < 0"), "arrival", "nothing")
    assert run_to_table(none, "empty", "append", deliveries=deliveries).count() == 0


def test_many_machines_share_the_calls_and_states_of_a_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(keyed, "KEY_BUCKETS", 4)
    rows = [(f"m{m}", t, float(m + 0.1 * t)) for m in range(40) for t in range(12)]
    src, out, state = (scratch_path(spark, n) for n in ("readings", "monitor", "state"))
    for low, high in ((0, 5), (5, 12)):
        _feed(spark, src, [r for r in rows if low <= r[1] < high], SENSOR_SCHEMA)
        query = write_batches(SS.monitor_stream(file_stream(spark, src, SENSOR_SCHEMA)), out, state, "append")
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    got = {(r.machine_id, r.t): (round(r.level, 9), round(r.slope, 9)) for r in spark.read.parquet(out).collect()}
    want = {(r.machine_id, r.t): (round(r.level, 9), round(r.slope, 9)) for r in S.kalman_monitor(spark.createDataFrame(rows, SENSOR_SCHEMA)).collect()}
    assert got == want
