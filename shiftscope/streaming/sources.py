"""Stream sources and the batch-addressed sink."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from shiftscope.session import scratch_path

SENSOR_SCHEMA = "machine_id string, t bigint, value double"
SENSOR_TOPIC = r"^factory/([^/]+)/vibration$"


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = 1000, glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream; ``files_per_trigger`` bounds the size of a micro-batch, None takes all there are."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """Messages of Kafka topics (needs the Kafka connector on the cluster): topic, body, received_at."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).load()
    return raw.select("topic", F.col("value").cast("string").alias("body"), F.col("timestamp").alias("received_at"))


def sensor_messages(messages: DataFrame) -> DataFrame:
    """(machine_id, t, value) of JSON messages (topic, body) on the vibration topics; others are dropped."""
    parsed = messages.where(F.col("topic").rlike(SENSOR_TOPIC)).select(F.from_json("body", SENSOR_SCHEMA).alias("m"))
    return parsed.select("m.*").where(F.col("machine_id").isNotNull() & F.col("value").isNotNull())


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write every micro-batch to its own sub-folder. A repeated batch overwrites itself, so a restart adds no rows."""

    def save(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def run_to_table(stream: DataFrame, name: str, mode: str = "update", key: list[str] | None = None, deliveries: Iterable = (None,)) -> DataFrame:
    """Drain the available input and return what was written; with ``key`` only the newest row of each key.

    The input is drained once for each of ``deliveries``, which may bring more input as it goes on.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    for _ in deliveries:
        write_batches(stream, path, checkpoint, mode).awaitTermination()
    written = spark.read.parquet(path)
    if key is None:
        return written.drop("batch")
    newest = Window.partitionBy(*key).orderBy(F.col("batch").desc())
    return written.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch")
