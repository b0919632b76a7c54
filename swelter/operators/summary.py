"""Accumulated index by year, month and month of year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.functions.numeric import nan_to_null
from swelter.params import SERIES_KEYS


def hsci_series(hw_day: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Day series with finite values only, in date order."""
    by = SERIES_KEYS if by is None else by
    clean = hw_day.select(*by, "d", nan_to_null(F.col("hsci").cast("double")).alias("hsci"))
    return clean.where(F.col("hsci").isNotNull()).orderBy(*by, "d")


def accumulate_hsci(hw_day: DataFrame, group_by: str = "year", by: list[str] | None = None) -> DataFrame:
    """Sum of the index and number of days above zero per period; empty periods stay absent."""
    by = SERIES_KEYS if by is None else by
    periods = {
        "year": [F.year("d").alias("year")],
        "month": [F.trunc("d", "month").alias("month")],
        "month-of-year": [F.month("d").alias("month_number"), F.date_format("d", "MMM").alias("month")],
    }
    if group_by not in periods:
        raise ValueError(f"group_by must be one of {sorted(periods)}, got {group_by!r}")
    value = nan_to_null(F.col("hsci").cast("double"))
    return (
        hw_day.select(*by, "d", value.alias("hsci"))
        .where(F.col("hsci").isNotNull())
        .groupBy(*by, *periods[group_by])
        .agg(F.sum("hsci").alias("ahsci"), F.count_if(F.col("hsci") > 0).alias("heatwave_days"))
    )
