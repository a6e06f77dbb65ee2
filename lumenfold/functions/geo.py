"""Distances and coordinate forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    sq = lambda x: x * x
    a = sq(F.sin(F.radians(lat2 - lat1) / 2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sq(F.sin(F.radians(lon2 - lon1) / 2))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def planar_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def off_null_island(x: Column) -> Column:
    return F.when(F.abs(x) > 0.001, x)


def pair_off_null_island(lat: Column, lon: Column) -> Column:
    """True if either coordinate is away from zero."""
    return (F.abs(lat) > 0.001) | (F.abs(lon) > 0.001)


def dms(degrees: Column) -> Column:
    """Degrees, minutes and ten-thousandths of seconds of an absolute angle."""
    a = F.abs(degrees)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    s = F.round(((a - d) * 60 - m) * 60 * 10000)
    return F.struct(d.cast("bigint").alias("deg"), m.cast("bigint").alias("min"), s.cast("bigint").alias("sec_e4"))
