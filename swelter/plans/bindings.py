"""Domain tables derived from the benchmark star schema.

The given tables have no climate data, so the roles of the domain are played by them:

* a grid cell is a supplier (10 columns wide) and its day value comes from the line items
  shipped that day: quantity is the temperature, discount the humidity;
* a dense raster is the part grid (50 columns wide) per quarter;
* an admission is an order, its ZIP the lowest supplier among its line items, its discharge
  the first shipment.

All of them grow with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swelter.functions.thermo import heat_index_c
from swelter.operators.climatology import exceedance_fused, season_calendar
from swelter.operators.events import persistent_days
from swelter.params import DAY_KEYS, SERIES_KEYS, DetectParams, GridShape

CELL_COLS = 10
RASTER_COLS = 50
PCTS = (80.0, 90.0, 95.0)

#: Detector settings scaled to the part raster: 1 km cells, components above 12 cells.
RASTER_PARAMS = DetectParams(
    region_area_km2=5000.0,
    pixel_size_km=1.0,
    min_area_km2=12.0,
    hull_gate_km2=20.0,
    min_hot_cells=90,
    cluster_cutoff_km=30.0,
    min_duration=2,
    tile=16,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _div(col: str, n: int):
    return F.floor(F.col(col) / n).cast("int")


def _mod(col: str, n: int):
    return (F.col(col) % n).cast("int")


def cell_day(spark: SparkSession, sf: str) -> DataFrame:
    """``(d, r, c, hi, t2)`` from line items; humidity from whole percents keeps it exact."""
    line = table(spark, sf, "lineitem").select(
        _div("l_suppkey", CELL_COLS).alias("r"), _mod("l_suppkey", CELL_COLS).alias("c"),
        F.col("l_shipdate").cast("date").alias("d"), "l_quantity",
        F.round(F.col("l_discount") * 100).cast("int").alias("pc"),
    )
    day = line.groupBy("d", "r", "c").agg(F.avg("l_quantity").alias("t"), (F.avg("pc") * 10.0).alias("rh"))
    return day.select(
        "d", "r", "c", heat_index_c(F.col("t"), F.col("rh")).cast("float").alias("hi"), F.col("t").cast("float").alias("t2")
    )


def _axis(df: DataFrame, index, start: float, step: float, bend: float) -> DataFrame:
    i = F.col("idx")
    squared = i.cast("bigint") * i  # passes 32 bits from index 46,341 on
    return df.select(index.alias("idx")).distinct().select(
        "idx", (F.lit(start) + i * F.lit(step) + squared * F.lit(bend)).alias("coord")
    )


def cell_axes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Row and column axes of the supplier grid, slightly uneven."""
    s = table(spark, sf, "supplier")
    return (
        _axis(s, _div("s_suppkey", CELL_COLS), 25.0, 0.1, 0.0005),
        _axis(s, _mod("s_suppkey", CELL_COLS), -100.0, 0.1, 0.0005),
    )


def raster_axes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part")
    return (
        _axis(p, _div("p_partkey", RASTER_COLS), 25.0, 0.05, 0.0),
        _axis(p, _mod("p_partkey", RASTER_COLS), -100.0, 0.05, 0.0),
    )


def _shape(df: DataFrame, key: str, width: int) -> GridShape:
    top = df.agg(F.max(key)).first()[0]
    return GridShape(int(top) // width + 1, width)


def cell_shape(spark: SparkSession, sf: str) -> GridShape:
    return _shape(table(spark, sf, "supplier"), "s_suppkey", CELL_COLS)


def raster_shape(spark: SparkSession, sf: str) -> GridShape:
    return _shape(table(spark, sf, "part"), "p_partkey", RASTER_COLS)


def mag(spark: SparkSession, sf: str, pcts=PCTS) -> DataFrame:
    return exceedance_fused(cell_day(spark, sf), pcts)


def domain_days(spark: SparkSession, sf: str, cells: DataFrame | None = None, pcts=PCTS) -> DataFrame:
    """Season days with the number of exceeding cells, an index, and whether the day is hot.

    A day is hot when more cells exceed than on the average season day.
    """
    cells = mag(spark, sf, pcts) if cells is None else cells
    total = table(spark, sf, "supplier").agg(F.count("*").alias("n")).scalar()
    series = F.explode(
        F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(p).alias("pct")) for m in ("t", "hi") for p in pcts])
    )
    # the lists of measures and percentiles are fixed, so this multiplies the calendar by a constant
    calendar = season_calendar(cell_day(spark, sf)).select("d", series.alias("s")).select("s.*", "d")
    daily = cells.groupBy(*DAY_KEYS).agg(F.count("*").alias("n"), F.avg("mag").alias("m"))
    days = calendar.join(daily, DAY_KEYS, "left").na.fill(0, ["n"])
    mean_n = F.avg("n").over(Window.partitionBy(*SERIES_KEYS))
    return days.select(*DAY_KEYS, "n", (F.col("m") * F.col("n") / total).alias("hsci"), (F.col("n") > mean_n).alias("is_hw"))


def hw_day(spark: SparkSession, sf: str, cells: DataFrame | None = None, pcts=PCTS) -> DataFrame:
    """Index on the days that belong to an event."""
    return persistent_days(domain_days(spark, sf, cells, pcts)).drop("is_hw")


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """Exceedance cells of the part grid; the day is the first of the quarter."""
    line = table(spark, sf, "lineitem")
    return (
        line.select(
            F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("d"),
            _div("l_partkey", RASTER_COLS).alias("r"), _mod("l_partkey", RASTER_COLS).alias("c"), "l_quantity",
        )
        .groupBy("d", "r", "c")
        .agg(F.avg("l_quantity").cast("float").alias("mag"))
        .select(F.lit("t").alias("measure"), F.lit(90.0).alias("pct"), "d", "r", "c", "mag")
    )


def patients(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, zip, admit_ts, discharge_ts, admit``: one row per order."""
    stay = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_suppkey").alias("s"), F.min("l_shipdate").alias("discharge_ts"))
    )
    return (
        table(spark, sf, "orders")
        .join(stay, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("row_id"), F.lpad(F.col("s").cast("string"), 5, "0").alias("zip"),
            F.col("o_orderdate").alias("admit_ts"), "discharge_ts", F.col("o_orderdate").cast("date").alias("admit"),
        )
    )


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """``zip, lat, lon`` near the supplier's cell; suppliers of one nation have no position."""
    s = table(spark, sf, "supplier")
    r, c = _div("s_suppkey", CELL_COLS), _mod("s_suppkey", CELL_COLS)
    off = F.col("s_acctbal") / 100000.0
    lat = F.lit(25.0) + r * 0.1 + r * r * 0.0005 + off
    lon = F.lit(-100.0) + c * 0.1 + c * c * 0.0005 - off
    known = F.col("s_nationkey") != 7
    return s.select(
        F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("zip"),
        F.when(known, lat).alias("lat"), F.when(known, lon).alias("lon"),
    )

