"""M as streams: drained with several micro-batches and compared with the same oracles as the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.change import rounded
from checks.events import _KAL, _RAW, _STATE, _utc, accepted, messages, readings
from checks.registry import query
from checks.standin import SCHEMAS
from shiftscope.operators.events import dedupe_events
from shiftscope.session import cut_lineage, scratch_path
from shiftscope.sources import webhooks as W
from shiftscope.streaming import daily, events as SE, sensors as SS
from shiftscope.streaming.sources import file_stream, run_to_table, sensor_messages

PARTS = 3


def _in_parts(df, order, name):
    """(stream, deliveries): the rows of ``df`` arrive in ``PARTS`` deliveries one after the other, in the given order.

    ``df`` is computed once. A delivery is written as files by many tasks when the one before it has been drained, and is one micro-batch.
    """
    spark, saved = df.sparkSession, cut_lineage(df)
    path = scratch_path(spark, name)
    low, high = saved.agg(F.min(order), F.max(order)).first()
    low, high = low or 0, high or 0
    step = (high - low) / PARTS
    # the folder is there, without rows, before the stream opens it
    spark.createDataFrame([], df.schema).write.parquet(path)

    def deliveries():
        for i in range(PARTS):
            first, last = low + i * step, low + (i + 1) * step
            inside = (F.col(order) > first) if i else F.lit(True)
            saved.where(inside & ((F.col(order) <= last) if i < PARTS - 1 else F.lit(True))).write.mode("append").parquet(path)
            yield i

    return file_stream(spark, path, df.schema, files_per_trigger=None), deliveries()


@query("A11_stream_source", "select user_id::varchar as machine_id, count(*) as n, round(sum(value), 4) as total from events group by 1")
def _(spark, sf):
    events = file_stream(spark, sf, SCHEMAS["events"], glob="events.parquet")
    topic = F.concat(F.lit("factory/"), F.col("user_id"), F.lit("/vibration"))
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("machine_id"), F.col("event_id").alias("t"), "value"))
    out = run_to_table(sensor_messages(events.select(topic.alias("topic"), body.alias("body"))), "sensors", "append")
    return rounded(out.groupBy("machine_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query("M3_land_events_stream", "select * from first", _RAW)
def _(spark, sf):
    stream, deliveries = _in_parts(messages(spark, sf), "arrival", "messages")
    rows = W.parse_webhook(stream).where("problem is null").select("arrival", "provider", "event_id", "event_type", "order_id", "occurred_at", "amount")
    landed, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "landing")
    for _ in deliveries:
        SE.land_events(rows, landed, checkpoint).awaitTermination()
    return _utc(spark.read.parquet(landed).drop("batch", "bucket"), "occurred_at")


@query("M4_order_state_stream", "select * from st", _STATE)
def _(spark, sf):
    stream, deliveries = _in_parts(dedupe_events(accepted(spark, sf)), "arrival", "events")
    return _utc(run_to_table(SE.order_state_stream(stream), "orders", "update", ["order_id"], deliveries), "payment_updated_at", "shipment_updated_at")


@query("M13_kalman_stream", """select machine_id::varchar as machine_id, t, value, round(level, 6) as level, round(slope, 6) as slope,
    coalesce(t = (select at_step from al where al.machine_id = kf.machine_id), false) as alert from kf""", _KAL)
def _(spark, sf):
    stream, deliveries = _in_parts(readings(spark, sf), "t", "readings")
    return rounded(run_to_table(SS.monitor_stream(stream, threshold=60.0), "monitor", "append", deliveries=deliveries).drop("eta"), "level", "slope")


@query("M15_alert_stream", "select machine_id::varchar as machine_id, at_step, smoothed_level, slope_per_step, predicted_steps_to_failure from al", _KAL)
def _(spark, sf):
    stream, deliveries = _in_parts(readings(spark, sf), "t", "readings")
    return run_to_table(SS.alert_stream(stream, threshold=60.0), "alerts", "append", deliveries=deliveries)


@query("M3_dedupe_recent_stream", "select distinct provider, event_id from ok where occurred_at is not null", _RAW)
def _(spark, sf):
    # deliveries of one event are days apart at most here; what has no time is left to land_events
    stream, deliveries = _in_parts(messages(spark, sf), "arrival", "messages")
    timed = W.parse_webhook(stream).where("problem is null and occurred_at is not null")
    recent = SE.dedupe_recent(timed.select("provider", "event_id", "occurred_at"), "60 days")
    return run_to_table(recent, "recent", "append", deliveries=deliveries).select("provider", "event_id")


@query("M17_daily_metrics_stream", """select event_type as series, ts::date as day, count(*) as n, round(sum(value), 4) as value from events group by 1, 2""")
def _(spark, sf):
    events = file_stream(spark, sf, SCHEMAS["events"], glob="events.parquet")
    out = run_to_table(daily.daily_metrics_stream(events, "event_type", "ts", F.sum("value")), "daily", "update", ["series", "day"])
    return rounded(out, "value", digits=4)
