"""Climatological percentiles per cell and month, and the daily exceedance above them.

Table shapes
    cell_day   (d, r, c, hi FLOAT, t2 FLOAT)          one row per cell and day
    threshold  (measure, pct, month, r, c, thr FLOAT)
    mag        (measure, pct, d, r, c, mag FLOAT)      only cells that exceed
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swelter.functions.dates import in_season
from swelter.functions.numeric import exceedance, nan_to_null
from swelter.functions.thermo import heat_index_c, relative_humidity
from swelter.params import SEASON_MONTHS, check_percentile

#: measure name -> column of ``cell_day`` that holds it
MEASURE_COLUMNS = {"hi": "hi", "t": "t2"}


def derive_cell_day(raw: DataFrame) -> DataFrame:
    """``(d, r, c, t, td)`` in Celsius -> ``cell_day`` with heat index and temperature as floats.
    The time of the file (``as_of``) is kept where it is given."""
    t, td = nan_to_null(F.col("t").cast("double")), nan_to_null(F.col("td").cast("double"))
    return raw.select(
        "d", "r", "c",
        heat_index_c(t, relative_humidity(td, t)).cast("float").alias("hi"),
        t.cast("float").alias("t2"),
        *[c for c in raw.columns if c == "as_of"],
    )


def hazen_rank(pct: float, n: Column) -> Column:
    """1-based fractional rank of the midpoint (type 5) percentile among ``n`` values."""
    return F.least(F.greatest(F.lit(pct / 100.0) * n + F.lit(0.5), F.lit(1.0)), n.cast("double"))


def hazen_from_sorted(values: Column, pct: float) -> Column:
    """Percentile of an ascending NULL-free array; NULL for an empty one."""
    n = F.size(values)
    rank = hazen_rank(pct, n)
    lo = F.try_element_at(values, F.floor(rank).cast("int")).cast("double")
    hi = F.try_element_at(values, F.ceil(rank).cast("int")).cast("double")
    return F.when(n > 0, lo + (rank - F.floor(rank)) * (hi - lo))


def hazen_percentiles(df: DataFrame, keys: Sequence[str], value: str, pcts: Sequence[float]) -> DataFrame:
    """Exact percentiles per group as rows ``(*keys, pct, n, q)``.

    One sorted array per group serves all percentiles. A group is one cell in one calendar
    month, so its length is bounded by the number of days on record for that month.
    """
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(nan_to_null(F.col(value)))).alias("_s"))
    rows = F.array(
        *[F.struct(F.lit(check_percentile(p)).alias("pct"), hazen_from_sorted(F.col("_s"), p).alias("q")) for p in pcts]
    )
    return grouped.select(*keys, F.size("_s").cast("bigint").alias("n"), F.inline(rows)).select(*keys, "pct", "n", "q")


def monthly_threshold(
    cell_day: DataFrame,
    pcts: Sequence[float],
    measures: Sequence[str] = ("hi", "t"),
    months: tuple[int, ...] = SEASON_MONTHS,
) -> DataFrame:
    """Threshold surfaces over all years, for every measure and percentile in one shuffle."""
    src = cell_day.where(F.month("d").isin(*months)).withColumn("month", F.month("d"))
    arrays = src.groupBy("month", "r", "c").agg(
        *[F.array_sort(F.collect_list(nan_to_null(F.col(MEASURE_COLUMNS[m])))).alias(f"_{m}") for m in measures]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"),
                F.lit(check_percentile(p)).alias("pct"),
                hazen_from_sorted(F.col(f"_{m}"), p).cast("float").alias("thr"),
            )
            for m in measures
            for p in pcts
        ]
    )
    return arrays.select("month", "r", "c", F.inline(rows)).select("measure", "pct", "month", "r", "c", "thr")


def exceedance_against(cell_day: DataFrame, threshold: DataFrame) -> DataFrame:
    """Exceedance over stored thresholds: the path for days added after the thresholds exist.

    The measures of a cell-day stay side by side until after the join, so the cube is
    shuffled once on (month, r, c); thresholds are pivoted to one row per cell and month.
    """
    src = cell_day.withColumn("month", F.month("d"))
    packed = threshold.groupBy("month", "r", "c").agg(
        F.collect_list(F.struct("measure", "pct", "thr")).alias("_thr")
    )
    value = F.when(F.col("measure") == "hi", F.col("hi")).otherwise(F.col("t2"))
    return (
        src.join(packed, ["month", "r", "c"])
        .select("d", "r", "c", "hi", "t2", F.inline("_thr"))
        .select("measure", "pct", "d", "r", "c", exceedance(nan_to_null(value), F.col("thr")).alias("mag"))
        .where(F.col("mag").isNotNull())
    )


def exceedance_fused(
    cell_day: DataFrame,
    pcts: Sequence[float],
    measures: Sequence[str] = ("hi", "t"),
    months: tuple[int, ...] = SEASON_MONTHS,
) -> DataFrame:
    """Thresholds and exceedances in a single shuffle of the cube.

    Ranks and counts are window functions over (month, r, c), so the values never leave
    their partition: no threshold table, no second pass, and the sort spills if it must.
    """
    cell = ["month", "r", "c"]
    src = cell_day.where(F.month("d").isin(*months)).select(
        "d", "r", "c", F.month("d").alias("month"),
        *[nan_to_null(F.col(MEASURE_COLUMNS[m])).alias(f"v_{m}") for m in measures],
    )
    whole = Window.partitionBy(*cell)
    ranked = src.select(
        "*",
        *[F.count(f"v_{m}").over(whole).alias(f"n_{m}") for m in measures],
        *[
            F.row_number().over(whole.orderBy(F.col(f"v_{m}").asc_nulls_last())).alias(f"k_{m}")
            for m in measures
        ],
    )
    picks, rows = [], []
    for m in measures:
        for i, p in enumerate(pcts):
            rank = hazen_rank(check_percentile(p), F.col(f"n_{m}"))
            v = F.col(f"v_{m}").cast("double")
            lo = F.max(F.when(F.col(f"k_{m}") == F.floor(rank), v)).over(whole)
            hi = F.max(F.when(F.col(f"k_{m}") == F.ceil(rank), v)).over(whole)
            picks += [lo.alias(f"lo_{m}_{i}"), hi.alias(f"hi_{m}_{i}")]
            low, high = F.col(f"lo_{m}_{i}"), F.col(f"hi_{m}_{i}")
            thr = (low + (rank - F.floor(rank)) * (high - low)).cast("float")
            rows.append(
                F.struct(
                    F.lit(m).alias("measure"),
                    F.lit(float(p)).alias("pct"),
                    exceedance(F.col(f"v_{m}"), thr).alias("mag"),
                )
            )
    return (
        ranked.select("*", *picks)
        .select("d", "r", "c", F.inline(F.array(*rows)))
        .where(F.col("mag").isNotNull())
        .select("measure", "pct", "d", "r", "c", "mag")
    )


def season_calendar(cell_day: DataFrame, months: tuple[int, ...] = SEASON_MONTHS) -> DataFrame:
    """Days of the season present in the record, whether or not any cell exceeds."""
    return cell_day.where(in_season(F.col("d"), months)).select("d").distinct()


def missing_days(wanted: DataFrame, present: DataFrame, keys: Sequence[str] = ("d",)) -> DataFrame:
    """Wanted keys with nothing stored for them yet."""
    return wanted.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")
