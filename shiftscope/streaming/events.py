"""Provider events as a stream: landing without duplicates, order state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shiftscope.operators.events import new_events, tracked_status
from shiftscope.sources.webhooks import PAYMENT_PROVIDER
from shiftscope.streaming.keyed import HELD, PLACE, ROCKSDB, ROWS, in_order, key_bucket, load_states, save_states

#: Parts of the landed table; a batch with few events reads few of them.
BUCKETS = 64
LANDED_SCHEMA = "arrival bigint, provider string, event_id string, event_type string, order_id string, occurred_at timestamp, amount bigint"


def bucket_of(buckets: int) -> Column:
    """The part of the landed table an event belongs to."""
    return F.pmod(F.xxhash64("provider", "event_id"), F.lit(buckets)).cast("int").alias("bucket")


def land_events(events: DataFrame, landed: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Append events that were never landed before, however old the first delivery is.

    The table is partitioned by a hash of (provider, event_id). A micro-batch asks which buckets it touches, at most ``buckets`` numbers, and
    reads the ids of these only. It is written below its own number (batch=N/bucket=B), so restarting a batch replaces it, and its own
    earlier attempt is not looked at. The number of buckets is fixed for the life of a table.
    """
    spark = events.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("bucket", bucket_of(buckets)).persist()
        try:
            touched = [r.bucket for r in placed.select("bucket").distinct().collect()]
            seen = landed_events(spark, landed).where(F.col("bucket").isin(touched) & (F.col("batch") != number))
            fresh = new_events(placed, seen.select("provider", "event_id"))
            # at most a file for each bucket that is touched
            fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{landed}/batch={number}")
        finally:
            placed.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def landed_events(spark: SparkSession, path: str) -> DataFrame:
    """The landed table with its columns batch and bucket; empty where there is none yet."""
    schema = f"{LANDED_SCHEMA}, batch bigint, bucket int"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def dedupe_recent(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeats that arrive within ``delay`` of event time. Cheaper than land_events, but it forgets."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["provider", "event_id"])


_OUTPUT = (
    "order_id string, payment_status string, shipment_status string, amount bigint, payment_at bigint, shipment_at bigint"
)


def _known(value) -> int | None:
    return None if value is None or value != value else int(value)


class OrderFold(StatefulProcessor):
    """Payment and shipment state per order of a bucket; an event applies unless it is older than or as old as the state of its side."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("orders", HELD)
        self.staged = handle.getMapState("staged", PLACE, ROWS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        orders, touched = load_states(self.state), {}
        for frame in in_order(rows, "seq", self.staged):
            for order, side, status, value, at in zip(frame["order_id"], frame["side"], frame["status"], frame["amount"], frame["at"]):
                pay, pay_at, amount, ship, ship_at = orders.get(order) or ("", None, None, "", None)
                touched[order] = None
                if status is not None and status == status:
                    at = _known(at)
                    current = pay_at if side == "payment" else ship_at
                    if current is None or at is None or at > current:
                        if side == "payment":
                            pay, pay_at, amount = status, at, _known(value)
                        else:
                            ship, ship_at = status, at
                orders[order] = (pay, pay_at, amount, ship, ship_at)
        save_states(self.state, orders)
        pay, pay_at, amount, ship, ship_at = zip(*[orders[order] for order in touched])
        whole = lambda values: pd.array(values, dtype="Int64")
        yield pd.DataFrame({"order_id": list(touched), "payment_status": pay, "shipment_status": ship, "amount": whole(amount),
                            "payment_at": whole(pay_at), "shipment_at": whole(ship_at)})

    def close(self) -> None:
        pass


def order_state_stream(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Order state kept by buckets of orders across micro-batches, in RocksDB; emits the new state of every order a batch touches."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.where(F.col("order_id") != "").select(
        "order_id", F.when(F.col("provider") == PAYMENT_PROVIDER, "payment").otherwise("shipment").alias("side"), tracked_status().alias("status"),
        "amount", F.unix_micros("occurred_at").alias("at"), F.col(arrival).alias("seq"),
    )
    states = rows.withColumn("bucket", key_bucket("order_id")).groupBy("bucket").transformWithStateInPandas(OrderFold(), _OUTPUT, "Update", "None")
    at = {f"{side}_updated_at": F.timestamp_micros(f"{side}_at") for side in ("payment", "shipment")}
    return states.withColumns(at).drop("payment_at", "shipment_at")
