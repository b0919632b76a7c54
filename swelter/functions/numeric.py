"""Small numeric and geographic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
RASTER_NODATA = -9999.0


def nan_to_null(value: Column) -> Column:
    """NaN and infinities become NULL: the engine keeps missing values as NULL only."""
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(value) & (F.abs(value) < inf), value)


def nodata_to_null(value: Column, sentinel: float = RASTER_NODATA) -> Column:
    return nan_to_null(F.when(value != F.lit(sentinel), value))


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km between two points given in degrees."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_dphi = (phi2 - phi1) / F.lit(2.0)
    half_dlam = (F.radians(lon2) - F.radians(lon1)) / F.lit(2.0)
    a = F.sin(half_dphi) * F.sin(half_dphi) + F.cos(phi1) * F.cos(phi2) * F.sin(half_dlam) * F.sin(half_dlam)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - a)))


def exceedance(value: Column, threshold: Column) -> Column:
    """Strictly positive part of ``value - threshold`` in single precision, else NULL."""
    excess = value.cast("float") - threshold.cast("float")
    return F.when(excess > 0, excess)


def as_flag(condition: Column) -> Column:
    """1.0 / 0.0 with missing inputs counted as 0.0."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))
