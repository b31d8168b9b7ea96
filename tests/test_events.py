import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftscope.operators import audit as A, events as E, sensors as S
from shiftscope.sources import webhooks as W


def _events(spark, n=1500, seed=5):
    rng = random.Random(seed)
    kinds = [*W.PAYMENT_STATUS, "payment.other"]
    rows = []
    for i in range(n):
        pay = rng.random() < 0.6
        at = None if rng.random() < 0.15 else datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60))
        rows.append((i, "razorpay" if pay else "shiprocket", rng.choice(kinds) if pay else f"shipment.s{rng.randrange(4)}",
                     f"o{0 if rng.random() < 0.33 else rng.randrange(1, 40)}", at, rng.randrange(100) if pay else None))
    return rows, spark.createDataFrame(rows, "arrival bigint, provider string, event_type string, order_id string, occurred_at timestamp, amount bigint")


def test_order_state_equals_the_sequential_rule(spark):
    rows, df = _events(spark)
    want = {}
    for _, provider, kind, order, at, amount in rows:
        s = want.setdefault(order, dict(p="", s="", a=None, pt=None, st=None))
        if provider == "razorpay":
            if kind not in W.PAYMENT_STATUS or (s["pt"] and at and at <= s["pt"]):
                continue
            s.update(p=W.PAYMENT_STATUS[kind], a=amount, pt=at)
        elif not (s["st"] and at and at <= s["st"]):
            s.update(s=kind.removeprefix("shipment."), st=at)
    got = {r.order_id: dict(p=r.payment_status, s=r.shipment_status, a=r.amount, pt=r.payment_updated_at, st=r.shipment_updated_at) for r in E.order_state(df).collect()}
    assert got == want


def test_messages_that_cannot_be_accepted(spark):
    rows = [("razorpay", "{oops"), ("other", "{}"), ("shiprocket", '{"order_id": 7, "current_status": "Delivered", "current_timestamp": "yesterday"}'),
            ("shiprocket", '{"order_id": 7, "current_status": "Delivered", "current_timestamp": "2024-01-01T10:00:00"}'), ("razorpay", "{}")]
    out = W.parse_webhook(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, provider string, body string")).orderBy("i").collect()
    assert [r.problem for r in out] == ["invalid JSON", "unknown provider", "invalid time", None, None]
    assert (out[3].order_id, out[3].event_type, out[3].occurred_at) == ("7", "shipment.delivered", datetime(2024, 1, 1, 10))
    assert (out[4].order_id, out[4].event_type, out[4].occurred_at) == ("", "", None)


def test_retries_and_replay(spark):
    waits = [r[0] for r in spark.range(1, 11).select(E.retry_seconds(F.col("id"))).collect()]
    assert waits[:3] == [20, 40, 80] and max(waits) == 3600
    rows = spark.createDataFrame([("a", "dead_letter", 5), ("b", "processed", 1)], "id string, status string, attempts int").withColumn("last_error", F.lit("x"))
    got = {r.id: (r.status, r.attempts) for r in E.replay(rows, F.lit(True)).collect()}
    assert got == {"a": ("received", 0), "b": ("processed", 1)}


@pytest.fixture(scope="module")
def wear(spark):
    rng = np.random.default_rng(0)
    rows = [(m, t, float(2 + (0.02 * t if m == "worn" else 0) + rng.normal(0, 0.5))) for m in ("worn", "healthy") for t in range(300)]
    return spark.createDataFrame(rows, "machine_id string, t bigint, value double")


def test_slope_is_recovered_and_blocks_change_nothing(wear):
    whole = {(r.machine_id, r.t): (r.level, r.slope) for r in S.kalman_monitor(wear).collect()}
    blocks = {(r.machine_id, r.t): (r.level, r.slope) for r in S.kalman_monitor(wear, block=37).collect()}
    assert abs(whole[("worn", 299)][1] - 0.02) < 0.005
    assert whole.keys() == blocks.keys()
    assert max(abs(a - b) for k in whole for a, b in zip(whole[k], blocks[k])) < 1e-9


def test_only_the_worn_machine_is_announced(wear):
    alerts = S.failure_alerts(S.kalman_monitor(wear), threshold=7.0)
    assert {r.machine_id for r in alerts.collect()} == {"worn"}


@pytest.fixture(scope="module")
def log(spark):
    rows = [(c, "run_recorded", f"{c}{i}", f"digest{c}{i}", f"2024-01-{i + 1:02d}", i) for c in "ab" for i in range(20)]
    out = A.append_chain(spark.createDataFrame(rows, "chain string, event string, run_id string, payload string, at string, order_no bigint"))
    return out.persist()


def _bad(df):
    return sorted((r.chain, r.seq) for r in A.verify_chain(df).collect())


def test_untouched_log_is_intact(log):
    assert _bad(log) == []
    assert log.where("chain = 'a'").orderBy("seq").first()["prev_hash"] == A.GENESIS


def test_tampering_is_found(log):
    edited = log.withColumn("payload", F.when((F.col("chain") == "a") & (F.col("seq") == 5), "x").otherwise(F.col("payload")))
    assert _bad(edited) == [("a", 5)]
    assert _bad(log.where("not (chain = 'b' and seq = 7)")) == [("b", 8)]
    swapped = log.withColumn("seq", F.when((F.col("chain") == "a") & F.col("seq").isin(3, 4), 7 - F.col("seq")).otherwise(F.col("seq")))
    assert ("a", 3) in _bad(swapped) and ("a", 4) in _bad(swapped)


def test_appending_continues_the_chain(spark, log):
    more = spark.createDataFrame([("a", "run_recorded", "a99", "d", "2024-02-01", 1)], "chain string, event string, run_id string, payload string, at string, order_no bigint")
    longer = log.unionByName(A.append_chain(more, A.chain_heads(log)))
    assert longer.where("chain = 'a'").agg(F.max("seq")).first()[0] == 21 and _bad(longer) == []
