"""Run archive, result export and run-to-failure sensor logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# fixed values: columns of the sensor log
SENSOR_COLUMNS = ["unit", "cycle", "op1", "op2", "op3", *[f"s{i}" for i in range(1, 22)]]
RUN_FOLDERS = 32


def archive_runs(runs: DataFrame, folder: str) -> None:
    """Whole runs as JSON below dataset=<name>/bucket=<n>, the bucket coming from the run id. An append writes one file for each folder it touches."""
    bucket = F.pmod(F.xxhash64(F.col("run_id").cast("string")), F.lit(RUN_FOLDERS))
    runs.withColumn("bucket", bucket).repartition("dataset", "bucket").write.mode("append").partitionBy("dataset", "bucket").json(folder)


def read_archived_run(spark: SparkSession, folder: str, schema, dataset: str, run_id) -> DataFrame:
    """One run; only the folder of its dataset and bucket is listed and read."""
    wanted = spark.range(1).select(F.pmod(F.xxhash64(F.lit(str(run_id))), F.lit(RUN_FOLDERS)).alias("b")).first()["b"]
    rows = spark.read.schema(schema).json(folder)
    return rows.where((F.col("dataset") == dataset) & (F.col("bucket") == wanted) & (F.col("run_id") == run_id)).drop("bucket")


def export_results(results: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each result set to its own sub-folder; returns the paths."""
    paths = {}
    for name, df in results.items():
        writer = df.write.mode("overwrite")
        paths[name] = f"{folder}/{name}"
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(paths[name])
    return paths


def read_sensor_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Whitespace-separated lines without a header: two whole numbers, then decimals."""
    columns = columns or SENSOR_COLUMNS
    cells = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path).where(F.trim(F.col("value")) != "").select(cells.alias("c"))
    return lines.select(*[F.col("c")[i].cast("int" if i < 2 else "double").alias(name) for i, name in enumerate(columns)])
