"""The nine shop tables: typed CSV load, Parquet read, copies, key audit and profile."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# ---- fixed values: column names, types and keys of the shop data format ----
SCHEMAS: dict[str, str] = {
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
    "customer_city string, customer_state string",
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
    "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
    "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, "
    "shipping_limit_date timestamp_ntz, price double, freight_value double",
    "order_payments": "order_id string, payment_sequential int, payment_type string, payment_installments int, "
    "payment_value double",
    "order_reviews": "review_id string, order_id string, review_score int, review_comment_title string, "
    "review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz",
    "products": "product_id string, product_category_name string, product_name_lenght int, "
    "product_description_lenght int, product_photos_qty int, product_weight_g int, product_length_cm int, "
    "product_height_cm int, product_width_cm int",
    "sellers": "seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string",
    "category_translation": "product_category_name string, product_category_name_english string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, "
    "geolocation_city string, geolocation_state string",
}
KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "order_reviews": ("review_id", "order_id"),
    "products": ("product_id",),
    "sellers": ("seller_id",),
    "category_translation": ("product_category_name",),
    "geolocation": (),
}
# ---- end of fixed values ----


class Shop:
    """The shop tables. A table may be given as a DataFrame or as a function that opens it on first use."""

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = sorted(set(tables) - set(SCHEMAS))
        if unknown:
            raise ValueError(f"unknown tables: {', '.join(unknown)}")
        self._tables = tables

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise ValueError(f"the shop has no table {name!r}")
        found = self._tables[name]
        if not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)

    def replace(self, **tables: DataFrame) -> Shop:
        return Shop(**{**self._tables, **tables})

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, self.table(name)) for name in self._tables]


def read_csv_tables(spark: SparkSession, files: dict[str, str]) -> Shop:
    """Read the nine CSV files with declared types; a missing file or entry fails before any job runs."""
    missing = sorted(set(SCHEMAS) - set(files))
    if missing:
        raise FileNotFoundError(f"no file given for: {', '.join(missing)}")
    return Shop(
        **{
            name: spark.read.schema(schema).option("header", True).option("multiLine", name == "order_reviews")
            .option("escape", '"').csv(files[name])
            for name, schema in SCHEMAS.items()
        }
    )


def save_tables(shop: Shop, folder: str, months: bool = False) -> None:
    """Write every table as Parquet; with ``months`` the orders are partitioned by purchase month for pruning."""
    for name, df in shop.items():
        if name == "orders" and months:
            month = F.date_format("order_purchase_timestamp", "yyyy-MM")
            # rebalanced by month: large months are split over several tasks, small ones share a task
            df = df.withColumn("purchase_month", month).hint("rebalance", "purchase_month")
            df.write.mode("overwrite").partitionBy("purchase_month").parquet(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def open_tables(spark: SparkSession, folder: str) -> Shop:
    return Shop(**{name: spark.read.parquet(f"{folder}/{name}") for name in SCHEMAS})


def read_table(spark: SparkSession, source: str) -> DataFrame:
    """A Parquet path, a table name, or a SELECT, as a DataFrame."""
    if source.lstrip().lower().startswith(("select", "with")):
        return spark.sql(source)
    if "/" in source:
        return spark.read.parquet(source)
    return spark.table(source)


def copy_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Snapshot a set of tables to another folder and return the copies."""
    out = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{folder}/{name}")
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for each table."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def key_audit(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """Uniqueness and NULL report of each declared key.

    The rows of a key are counted with a map-side combine, so repeated keys do not travel.
    """
    reports = []
    for name, df in tables.items():
        cols = list(keys.get(name, ()))
        if not cols:
            continue
        null_key = reduce(Column.__or__, [F.col(c).isNull() for c in cols])
        per_key = df.groupBy(*cols).agg(F.count("*").alias("n"))
        reports.append(
            per_key.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                F.count("*").alias("distinct_keys"),
                F.coalesce(F.sum(F.when(null_key, F.col("n"))), F.lit(0)).alias("null_keys"),
                F.count_if(F.col("n") > 1).alias("repeated_keys"),
            ).select(F.lit(name).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"), "*")
        )
    return reduce(DataFrame.unionByName, reports)


def profile_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column: its type, NULL count and text form of its smallest and largest value."""
    reports = []
    for name, df in tables.items():
        plain = [f for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
        aggs = []
        for f in plain:
            aggs += [F.count_if(F.col(f.name).isNull()).alias(f"n_{f.name}"), F.min(f.name).alias(f"a_{f.name}"),
                     F.max(f.name).alias(f"z_{f.name}")]
        one = df.agg(*aggs)
        rows = [
            F.struct(
                F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"),
                F.col(f"n_{f.name}").alias("null_count"), F.col(f"a_{f.name}").cast("string").alias("min_value"),
                F.col(f"z_{f.name}").cast("string").alias("max_value"),
            )
            for f in plain
        ]
        reports.append(one.select(F.lit(name).alias("table_name"), F.explode(F.array(*rows)).alias("r")).select("table_name", "r.*"))
    return reduce(DataFrame.unionByName, reports)
