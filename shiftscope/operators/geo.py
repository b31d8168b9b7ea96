"""Delivery stops, route lengths, regional demand and carrier plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from shiftscope.functions.geo import haversine_km
from shiftscope.functions.numbers import ratio
from shiftscope.sources.tables import Shop

STOP_LIMIT = 60


def zip_centres(geolocation: DataFrame) -> DataFrame:
    """One mean point per zip prefix (the table has many rows per prefix)."""
    return geolocation.groupBy(F.col("geolocation_zip_code_prefix").alias("zip")).agg(
        F.avg("geolocation_lat").alias("lat"), F.avg("geolocation_lng").alias("lng")
    )


def order_stops(shop: Shop, box: tuple[float, float, float, float], limit: int = STOP_LIMIT) -> DataFrame:
    """The earliest ``limit`` orders of every (city, day) as stops, then those outside the box are left out.

    ``limit`` is part of the planning rule. Each task keeps only its first rows per (city, day) before the shuffle.
    """
    orders = shop.orders.select("order_id", "customer_id", "order_purchase_timestamp", F.to_date("order_purchase_timestamp").alias("day"))
    people = shop.customers.select("customer_id", F.col("customer_city").alias("city"), F.col("customer_zip_code_prefix").alias("zip"))
    placed = orders.join(people, "customer_id").join(zip_centres(shop.geolocation), "zip")
    first = Window.partitionBy("city", "day").orderBy("order_purchase_timestamp", "order_id")
    numbered = placed.withColumn("stop_no", F.row_number().over(first)).where(F.col("stop_no") <= limit)
    low_lat, high_lat, low_lng, high_lng = box
    inside = (F.col("lat") > low_lat) & (F.col("lat") < high_lat) & (F.col("lng") > low_lng) & (F.col("lng") < high_lng)
    return numbered.where(inside).select("city", "day", "stop_no", "order_id", "lat", "lng")


def distance_pairs(stops: DataFrame) -> DataFrame:
    """Upper half of the distance matrix of every (city, day); ``order_stops`` bounds the stops of a group."""
    a = stops.select("city", "day", F.col("stop_no").alias("from_stop"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    b = stops.select("city", "day", F.col("stop_no").alias("to_stop"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    pairs = a.join(b, ["city", "day"]).where(F.col("from_stop") < F.col("to_stop"))
    return pairs.select("city", "day", "from_stop", "to_stop", haversine_km(*map(F.col, ("lat1", "lng1", "lat2", "lng2"))).alias("km"))


def arrival_route_km(stops: DataFrame, depot: tuple[float, float], vehicles: int = 4) -> DataFrame:
    """Length of the plan that fills vans in arrival order, for every (city, day)."""
    group = Window.partitionBy("city", "day")  # bounded by the stop limit
    van = F.floor((F.row_number().over(group.orderBy("stop_no")) - 1) / F.ceil(F.count("*").over(group) / vehicles))
    rows = stops.withColumn("van", van)
    tour = Window.partitionBy("city", "day", "van").orderBy("stop_no")
    home_lat, home_lng = F.lit(depot[0]), F.lit(depot[1])
    leg = haversine_km(
        F.coalesce(F.lag("lat").over(tour), home_lat), F.coalesce(F.lag("lng").over(tour), home_lng), F.col("lat"), F.col("lng")
    )
    back = F.when(F.lead("stop_no").over(tour).isNull(), haversine_km(F.col("lat"), F.col("lng"), home_lat, home_lng)).otherwise(0.0)
    legs = rows.withColumn("km", leg + back)
    return legs.groupBy("city", "day").agg(
        F.count("*").alias("stops"), (F.max("van") + 1).alias("vans"), F.round(F.sum("km"), 1).alias("route_km")
    )


def daily_demand(shop: Shop, start: str, end: str, regions: Sequence[str], days: int = 30) -> DataFrame:
    """Average orders per day of each named region; all others together."""
    at = F.col("order_purchase_timestamp")
    orders = shop.orders.where((at >= F.lit(start).cast("date")) & (at < F.lit(end).cast("date"))).select("customer_id")
    state = F.col("customer_state")
    region = F.when(state.isin(*regions), state).otherwise("other").alias("region")
    counted = orders.join(shop.customers, "customer_id").groupBy(region).agg(F.count("*").alias("orders"))
    return counted.select("region", F.bround(F.col("orders") / days).cast("int").alias("per_day"))


def score_allocation(plan: DataFrame, rates: DataFrame, demand: DataFrame) -> DataFrame:
    """Cost, expected late parcels and rule violations of a given plan.

    plan(carrier, region, parcels); rates(carrier, region, cost_per_parcel, on_time_rate, capacity_per_day);
    demand(region, per_day).
    """
    priced = plan.join(rates, ["carrier", "region"])
    late = F.col("parcels") * (1 - F.col("on_time_rate"))
    cost = priced.agg(
        F.sum(F.col("parcels") * F.col("cost_per_parcel")).alias("shipping_cost"), F.sum(late).alias("expected_late_parcels"),
        ratio(F.sum(late), F.sum("parcels")).alias("expected_late_rate"),
    )
    load = priced.groupBy("carrier").agg(F.sum("parcels").alias("load"), F.max("capacity_per_day").alias("capacity"))
    over = load.agg(F.count_if(F.col("load") > F.col("capacity")).alias("n")).select("n").scalar()
    planned = plan.groupBy("region").agg(F.sum("parcels").alias("parcels"))
    gap = demand.join(planned, "region", "full").where(F.coalesce("per_day", F.lit(0)) != F.coalesce("parcels", F.lit(0)))
    unmet = gap.agg(F.count("*").alias("n")).select("n").scalar()
    return cost.withColumn("carriers_over_capacity", over).withColumn("regions_off_demand", unmet)
