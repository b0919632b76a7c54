"""ZIP centroids, their cell windows on the grid, and the daily exposure of a ZIP."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.functions.numeric import haversine_km, nan_to_null
from swelter.functions.text import LAT_NAMES, LON_NAMES, ZIP_NAMES, find_column, normalize_zip
from swelter.operators.grid import axis_at_cell, nearest_index
from swelter.params import GridShape


def zip_centroids(raw: DataFrame) -> DataFrame:
    """``(zip, lat, lon)`` from any table whose headers can be recognised; not yet unique."""
    names = [find_column(raw.columns, wanted) for wanted in (ZIP_NAMES, LAT_NAMES, LON_NAMES)]
    if None in names:
        raise ValueError(f"could not identify ZIP, latitude and longitude among {raw.columns}")
    z, lat, lon = (F.col(f"`{n}`") for n in names)
    number = lambda c: nan_to_null(F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    keep = [c for c in raw.columns if c not in names]
    return raw.select(normalize_zip(z).alias("zip"), number(names[1]).alias("lat"), number(names[2]).alias("lon"), *keep)


def last_per_zip(centroids: DataFrame, order: str) -> DataFrame:
    """One row per ZIP: the last in file order wins."""
    latest = F.max_by(F.struct("lat", "lon"), order).alias("_at")
    return centroids.groupBy("zip").agg(latest, F.max(order).alias(order)).select("zip", order, "_at.lat", "_at.lon")


def distinct_zips(patients: DataFrame) -> DataFrame:
    return patients.where(F.col("zip").isNotNull()).select("zip").distinct().orderBy("zip")


def zip_window(
    centroids: DataFrame, axis_row: DataFrame, axis_col: DataFrame, shape: GridShape, buffer: int = 1
) -> DataFrame:
    """Rectangle ``r0..r1, c0..c1`` of cells around each located ZIP, clipped to the grid."""
    placed = centroids.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    placed = nearest_index(placed, axis_row, "lat", "r_near")
    placed = nearest_index(placed, axis_col, "lon", "c_near")

    def lo(name: str):
        return F.greatest(F.col(name) - buffer, F.lit(0))

    def hi(name: str, n: int):
        return F.least(F.col(name) + buffer, F.lit(n - 1))

    return placed.select(
        "zip", "lat", "lon", "r_near", "c_near",
        lo("r_near").alias("r0"), hi("r_near", shape.ny).alias("r1"),
        lo("c_near").alias("c0"), hi("c_near", shape.nx).alias("c1"),
    )


def window_cells(windows: DataFrame, axis_row: DataFrame, axis_col: DataFrame) -> DataFrame:
    """The cells of every ZIP window with their distance from the centroid."""
    cells = windows.select("zip", "lat", "lon", F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1")
    cells = cells.select("zip", "lat", "lon", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    cells = axis_at_cell(axis_at_cell(cells, axis_row, "r", "_la"), axis_col, "c", "_lo")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo"))
    return cells.select("zip", "r", "c", km.alias("km"))


def zip_day(mag: DataFrame, cells: DataFrame, nearest: bool = False) -> DataFrame:
    """Mean exceedance over the exceeding cells of a ZIP window, per percentile and day.

    With ``nearest`` also the exceeding cell closest to the centroid (first in row-major
    order on ties) as ``near_km`` and ``near_mag``. The window table has at most one entry
    per ZIP code and window cell; stored, so that Spark knows whether it is small enough to copy
    and the cube is then filtered and partially aggregated where it is read.
    """
    aggs = [F.avg("mag").alias("v")]
    if nearest:
        first = F.min_by(F.struct("km", "mag"), F.struct("km", "r", "c")).alias("near")
        aggs.append(first)
    hot = mag.where("mag > 0").join(cells, ["r", "c"])
    return hot.groupBy("pct", "zip", "d").agg(*aggs)


def spatial_window(mag: DataFrame, windows: DataFrame) -> DataFrame:
    """Raw cells of the cube inside each ZIP window."""
    cells = windows.select("zip", F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1")
    cells = cells.select("zip", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    return mag.join(cells, ["r", "c"])
