"""O: geography and logistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.change import rounded
from checks.registry import query
from checks.standin import shop
from shiftscope.functions.geo import haversine_km
from shiftscope.operators import geo as G

BOX = (-23.56, -23.35, -46.6, -46.45)
DEPOT = (-23.5, -46.6)
_BOX = "lat > -23.56 and lat < -23.35 and lng > -46.6 and lng < -46.45"


def _hav(a1, o1, a2, o2) -> str:
    return (f"2 * 6371 * asin(sqrt(pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) "
            f"* pow(sin(radians({o2} - {o1}) / 2), 2)))")


_STOPS = f"""zc as (select geolocation_zip_code_prefix as zip, avg(geolocation_lat) as lat, avg(geolocation_lng) as lng from sh_geo group by 1),
  stops as (select city, day, stop_no, order_id, lat, lng from (select customer_city as city, order_purchase_timestamp::date as day, order_id, lat, lng,
    row_number() over (partition by customer_city, order_purchase_timestamp::date order by order_purchase_timestamp, order_id)::int as stop_no
    from sh_orders join sh_customers using (customer_id) join zc on zip = customer_zip_code_prefix) where stop_no <= 60 and {_BOX})"""


def _stops(spark, sf):
    return G.order_stops(shop(spark, sf), BOX)


@query("O1_haversine", f"""select geolocation_zip_code_prefix as zip, round(max({_hav('-23.5', '-46.6', 'geolocation_lat', 'geolocation_lng')}), 6) as km
    from sh_geo group by 1""")
def _(spark, sf):
    km = haversine_km(F.lit(DEPOT[0]), F.lit(DEPOT[1]), F.col("geolocation_lat"), F.col("geolocation_lng"))
    return rounded(shop(spark, sf).geolocation.groupBy(F.col("geolocation_zip_code_prefix").alias("zip")).agg(F.max(km).alias("km")), "km")


@query("O2_order_stops", "select city, day, stop_no, order_id, round(lat, 6) as lat, round(lng, 6) as lng from stops", _STOPS)
def _(spark, sf):
    return rounded(_stops(spark, sf), "lat", "lng")


@query("O3_distance_pairs", f"""select a.city, a.day, a.stop_no as from_stop, b.stop_no as to_stop, round({_hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 6) as km
    from stops a join stops b on a.city = b.city and a.day = b.day and a.stop_no < b.stop_no""", _STOPS)
def _(spark, sf):
    return rounded(G.distance_pairs(_stops(spark, sf)), "km")


@query("O4_arrival_route_km", f"""select city, day, count(*) as stops, max(van) + 1 as vans, round(sum(km), 1) as route_km from (select *,
    {_hav('coalesce(lag(lat) over w, -23.5)', 'coalesce(lag(lng) over w, -46.6)', 'lat', 'lng')}
    + case when lead(stop_no) over w is null then {_hav('lat', 'lng', '-23.5', '-46.6')} else 0 end as km from (
      select *, ((row_number() over (partition by city, day order by stop_no) - 1) // ceil(count(*) over (partition by city, day) / 4.0)::bigint)::bigint as van
      from stops) window w as (partition by city, day, van order by stop_no)) group by 1, 2""", _STOPS)
def _(spark, sf):
    return G.arrival_route_km(_stops(spark, sf), DEPOT)


_DEMAND = """dem as (select case when customer_state in ('NATION_1', 'NATION_2', 'NATION_3') then customer_state else 'other' end as region,
    round_even(count(*) / 30.0, 0)::int as per_day from sh_orders join sh_customers using (customer_id)
    where order_purchase_timestamp >= timestamp '1997-04-01' and order_purchase_timestamp < timestamp '1997-05-01' group by 1)"""
_NAMED = ["NATION_1", "NATION_2", "NATION_3"]


@query("O5_daily_demand", "select * from dem", _DEMAND)
def _(spark, sf):
    return G.daily_demand(shop(spark, sf), "1997-04-01", "1997-05-01", _NAMED)


_PLAN = """pl as (select case when l_suppkey % 2 = 0 then 'east' else 'west' end as carrier, case when n_name in ('NATION_1', 'NATION_2', 'NATION_3')
      then n_name else 'other' end as region, count(*) as parcels from lineitem join supplier on s_suppkey = l_suppkey
      join nation on n_nationkey = s_nationkey group by 1, 2),
    rt as (select carrier, region, case carrier when 'east' then 9.5 else 8.25 end::double as cost_per_parcel,
      case carrier when 'east' then 0.95 else 0.9 end::double as on_time_rate, case carrier when 'east' then 20000 else 40000 end as cap from (select distinct carrier, region from pl))"""


@query("O6_score_allocation", f"""select round(sum(parcels * cost_per_parcel), 2) as shipping_cost, round(sum(parcels * (1 - on_time_rate)), 4) as expected_late_parcels,
    round(sum(parcels * (1 - on_time_rate)) / sum(parcels), 6) as expected_late_rate,
    (select count(*) from (select carrier, sum(parcels) as ld, max(cap) as cp from pl join rt using (carrier, region) group by 1) where ld > cp) as carriers_over_capacity,
    (select count(*) from (select region, sum(parcels) as p from pl group by 1) full join dem using (region) where coalesce(p, 0) <> coalesce(per_day, 0)) as regions_off_demand
    from pl join rt using (carrier, region)""", f"{_DEMAND}, {_PLAN}")
def _(spark, sf):
    s = shop(spark, sf)
    state = F.col("seller_state")
    rows = s.order_items.join(s.sellers, "seller_id")
    carrier = F.when(F.col("seller_id") % 2 == 0, "east").otherwise("west").alias("carrier")
    region = F.when(state.isin(*_NAMED), state).otherwise("other").alias("region")
    plan = rows.groupBy(carrier, region).agg(F.count("*").alias("parcels"))
    east = F.col("carrier") == "east"
    rates = plan.select("carrier", "region", F.when(east, 9.5).otherwise(8.25).alias("cost_per_parcel"),
                        F.when(east, 0.95).otherwise(0.9).alias("on_time_rate"), F.when(east, 20000).otherwise(40000).alias("capacity_per_day"))
    out = G.score_allocation(plan, rates, G.daily_demand(s, "1997-04-01", "1997-05-01", _NAMED))
    return rounded(rounded(out, "shipping_cost", digits=2), "expected_late_parcels", digits=4).withColumn(
        "expected_late_rate", F.round("expected_late_rate", 6))
