"""The shop tables derived from the driver tables, once for Spark and once as DuckDB views (sh_*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftscope.sources.tables import Shop


# declared types of the driver tables, so that opening one costs no job
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


SHOP_SQL = {
    "sh_orders": """
        select o_orderkey as order_id, o_custkey as customer_id,
          case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' else 'canceled' end as order_status,
          o_orderdate as order_purchase_timestamp,
          case when o_orderkey % 50 <> 0 then o_orderdate + interval '1' day end as order_approved_at,
          case when o_orderstatus <> 'P' then o_orderdate + interval '3' day end as order_delivered_carrier_date,
          case when o_orderstatus = 'F' then o_orderdate + cast(o_orderkey % 37 as int) * interval '1' day end
            as order_delivered_customer_date,
          o_orderdate + interval '30' day as order_estimated_delivery_date from orders""",
    "sh_customers": """
        select c_custkey as customer_id, c_custkey as customer_unique_id, cast(c_custkey % 1000 as int) as customer_zip_code_prefix,
          c_mktsegment as customer_city, n_name as customer_state from customer join nation on n_nationkey = c_nationkey""",
    "sh_items": """
        select l_orderkey as order_id, l_linenumber as order_item_id, l_partkey as product_id, l_suppkey as seller_id,
          l_shipdate as shipping_limit_date, l_extendedprice as price, l_extendedprice * l_tax as freight_value from lineitem""",
    "sh_payments": """
        select l_orderkey as order_id, l_linenumber as payment_sequential,
          case l_returnflag when 'A' then 'boleto' when 'N' then 'credit_card' else 'voucher' end as payment_type,
          1 + l_linenumber as payment_installments, l_extendedprice as payment_value from lineitem""",
    "sh_reviews": """
        select l_orderkey * 8 + l_linenumber as review_id, l_orderkey as order_id,
          1 + cast(l_quantity as int) % 5 as review_score, l_shipdate as review_creation_date from lineitem""",
    "sh_products": """
        select p_partkey as product_id, case when p_size % 10 = 0 then null else p_brand end as product_category_name,
          p_size % 5 as product_photos_qty, case when p_size % 7 = 0 then null else p_size * 100 end as product_weight_g from part""",
    "sh_sellers": """
        select s_suppkey as seller_id, cast(s_suppkey % 1000 as int) as seller_zip_code_prefix,
          concat('city_', cast(s_suppkey % 11 as varchar)) as seller_city, n_name as seller_state
        from supplier join nation on n_nationkey = s_nationkey""",
    "sh_translation": """
        select distinct p_brand as product_category_name, concat('en_', lower(p_brand)) as product_category_name_english from part""",
    "sh_geo": """
        select cast(c_custkey % 1000 as int) as geolocation_zip_code_prefix, -23.55 + (c_custkey % 100) / 500.0 as geolocation_lat,
          -46.63 + (c_custkey * 7 % 100) / 500.0 as geolocation_lng from customer""",
}


def shop(spark: SparkSession, sf_dir: str) -> Shop:
    t = lambda name: table(spark, sf_dir, name)
    key, bought, state = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    day = F.expr("interval '1' day")
    nation = lambda: t("nation").select("n_nationkey", "n_name")
    lines = lambda: t("lineitem")
    return Shop(
        orders=lambda: t("orders").select(
            key.alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.when(state == "F", "delivered").when(state == "O", "shipped").otherwise("canceled").alias("order_status"),
            bought.alias("order_purchase_timestamp"),
            F.when(key % 50 != 0, bought + day).alias("order_approved_at"),
            F.when(state != "P", bought + F.expr("interval '3' day")).alias("order_delivered_carrier_date"),
            F.when(state == "F", bought + (key % 37).cast("int") * day).alias("order_delivered_customer_date"),
            (bought + F.expr("interval '30' day")).alias("order_estimated_delivery_date"),
        ),
        customers=lambda: t("customer").join(nation(), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("customer_id"), F.col("c_custkey").alias("customer_unique_id"),
            (F.col("c_custkey") % 1000).cast("int").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"), F.col("n_name").alias("customer_state"),
        ),
        order_items=lambda: lines().select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"), F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        ),
        order_payments=lambda: lines().select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("payment_sequential"),
            F.when(F.col("l_returnflag") == "A", "boleto").when(F.col("l_returnflag") == "N", "credit_card").otherwise("voucher")
            .alias("payment_type"),
            (F.col("l_linenumber") + 1).alias("payment_installments"), F.col("l_extendedprice").alias("payment_value"),
        ),
        order_reviews=lambda: lines().select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("review_id"), F.col("l_orderkey").alias("order_id"),
            (F.col("l_quantity").cast("int") % 5 + 1).alias("review_score"), F.col("l_shipdate").alias("review_creation_date"),
        ),
        products=lambda: t("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("product_category_name"),
            (F.col("p_size") % 5).alias("product_photos_qty"),
            F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 100).alias("product_weight_g"),
        ),
        sellers=lambda: t("supplier").join(nation(), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("seller_id"), (F.col("s_suppkey") % 1000).cast("int").alias("seller_zip_code_prefix"),
            F.concat(F.lit("city_"), F.col("s_suppkey") % 11).alias("seller_city"), F.col("n_name").alias("seller_state"),
        ),
        category_translation=lambda: t("part").select(
            F.col("p_brand").alias("product_category_name"), F.concat(F.lit("en_"), F.lower("p_brand")).alias("product_category_name_english")
        ).distinct(),
        geolocation=lambda: t("customer").select(
            (F.col("c_custkey") % 1000).cast("int").alias("geolocation_zip_code_prefix"),
            (F.lit(-23.55) + (F.col("c_custkey") % 100) / 500.0).alias("geolocation_lat"),
            (F.lit(-46.63) + (F.col("c_custkey") * 7 % 100) / 500.0).alias("geolocation_lng"),
        ),
    )
