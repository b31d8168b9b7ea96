"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    dlat, dlng = (a2 - a1) / 2, (F.radians(lng2) - F.radians(lng1)) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(a1) * F.cos(a2) * F.sin(dlng) * F.sin(dlng)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
