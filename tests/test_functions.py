import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter import params
from swelter.functions import dates, numeric, text, thermo
from swelter.plans.append import output_columns


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def heat_index_by_hand(t, rh):
    f = t * 1.8 + 32
    if f < 80:
        hi = 0.5 * (f + 61 + 1.2 * (f - 68) + 0.094 * rh)
    else:
        hi = (
            -42.379 + 2.04901523 * f + 10.14333127 * rh - 0.22475541 * f * rh - 6.83783e-3 * f**2 - 5.481717e-2 * rh**2
            + 1.22874e-3 * f**2 * rh + 8.5282e-4 * f * rh**2 - 1.99e-6 * f**2 * rh**2
        )
        if rh < 13 and f <= 112:
            hi -= (13 - rh) / 4 * math.sqrt((17 - abs(f - 95)) / 17)
        if rh > 85 and f <= 87:
            hi += (rh - 85) / 10 * (87 - f) / 5
    return (hi - 32) / 1.8


def test_heat_index_covers_all_branches(spark):
    cases = [(t, rh) for t in (10.0, 26.0, 26.7, 28.0, 30.5, 35.0, 44.4, 45.0) for rh in (0.0, 5.0, 13.0, 50.0, 85.0, 95.0, 104.0)]
    df = spark.createDataFrame(cases, "t double, rh double")
    for row in df.withColumn("hi", thermo.heat_index_c(F.col("t"), F.col("rh"))).collect():
        assert row.hi == pytest.approx(heat_index_by_hand(row.t, row.rh), abs=1e-9)
    empty = spark.createDataFrame([(None, 50.0), (30.0, None)], "t double, rh double")
    assert all(r.hi is None for r in empty.select(thermo.heat_index_c(F.col("t"), F.col("rh")).alias("hi")).collect())


def test_humidity_is_not_clamped(spark):
    row = one(spark, over=thermo.relative_humidity(F.lit(25.0), F.lit(20.0)), same=thermo.relative_humidity(F.lit(20.0), F.lit(20.0)))
    assert row.over > 100 and row.same == pytest.approx(100)


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-9999.0,), (1.5,), (None,)], "v double")
    got = [r.v for r in df.select(numeric.nodata_to_null(F.col("v")).alias("v")).collect()]
    assert got == [None, None, None, 1.5, None]


def test_exceedance_is_strict_and_single_precision(spark):
    df = spark.createDataFrame([(30.1, 30.1), (30.2, 30.1), (None, 1.0), (1.0, None)], "v float, t float")
    got = [r.m for r in df.select(numeric.exceedance(F.col("v"), F.col("t")).alias("m")).collect()]
    assert got == [None, float(np.float32(30.2) - np.float32(30.1)), None, None]


def test_rounding_is_half_up(spark):
    assert one(spark, a=numeric.round_half_up(F.lit(2.5)), b=numeric.round_half_up(F.lit(3.49))) == (3, 3)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2023-07-05", dt.date(2023, 7, 5)), (" 7/5/2023 ", dt.date(2023, 7, 5)), ("07/05/2023", dt.date(2023, 7, 5)),
        ("20230705", dt.date(2023, 7, 5)), ("Jul 5, 2023", dt.date(2023, 7, 5)), ("2023-07-05 13:30", dt.date(2023, 7, 5)),
        ("7/12/20", dt.date(2020, 7, 12)), ("7/12/85", dt.date(1985, 7, 12)), ("7/12/2020 5:30 PM", dt.date(2020, 7, 12)),
        ("2020-07-12 05:30:00.5", dt.date(2020, 7, 12)), ("2020-07-12T05:30:00Z", dt.date(2020, 7, 12)),
        ("2020-07-12T05:30:00.125+02:00", dt.date(2020, 7, 12)), ("12.07.2020", dt.date(2020, 12, 7)), ("7/12/20 5:30 pm", dt.date(2020, 7, 12)),
        ("NaN", None), ("n/a", None), ("", None), ("2023-13-40", None), ("soon", None), (None, None),
    ],
)
def test_parse_date_safe(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(dates.parse_date_safe(F.col("s")).cast("date").alias("d")).first().d == want


def test_clock_times_are_kept(spark):
    rows = [("7/12/2020 5:30 PM", dt.datetime(2020, 7, 12, 17, 30)), ("2020-07-12T05:30:00.5Z", dt.datetime(2020, 7, 12, 5, 30))]
    df = spark.createDataFrame([(r,) for r, _ in rows], "s string").select(dates.parse_date_safe(F.col("s")).alias("t"))
    assert [x.t for x in df.collect()] == [t for _, t in rows]


def test_dates_from_strings_skip_longer_numbers(spark):
    rows = [(1, "a_20230705.bil 20230706"), (2, "120230707"), (3, "20231340"), (4, "x20230705"), (5, "18991231")]
    got = dates.dates_from_strings(spark.createDataFrame(rows, "i int, s string"), "s", "i").orderBy("d").collect()
    assert [(r.d, r.first_row, r.first_pos) for r in got] == [(dt.date(2023, 7, 5), 1, 0), (dt.date(2023, 7, 6), 1, 1)]


def test_day_numbers(spark):
    row = one(
        spark, a=dates.datenum_to_date(F.lit(719529.0)), b=dates.datenum_to_date(F.lit(738000.75)),
        d=dates.from_yyyymmdd(F.lit(20240229.0)),
        e=dates.from_yyyymmdd(F.lit(20230229)),
    )
    assert row == (dt.date(1970, 1, 1), dt.date(2020, 7, 28), dt.date(2024, 2, 29), None)


def test_length_of_stay(spark):
    rows = [("2023-07-01", "2023-07-04"), ("2023-07-04", "2023-07-01"), ("2023-07-01", None), ("2023-07-01 18:00", "2023-07-03 09:00")]
    df = spark.createDataFrame(rows, "a string, d string").select(
        dates.parse_date_safe(F.col("a")).alias("a"), dates.parse_date_safe(F.col("d")).alias("d")
    )
    got = [tuple(r) for r in df.select(*dates.length_of_stay(F.col("a"), F.col("d")).values()).collect()]
    assert got == [(3.0, 1.0, 0.0), (None, None, 1.0), (None, None, 0.0), (1.0, 0.0, 0.0)]


@pytest.mark.parametrize(
    ("raw", "want"), [(" 501.0 ", "00501"), ("32608", "32608"), ("1234567", "1234567"), ("-12", "-0012"), ("1.5", "001.5"), (None, None)]
)
def test_normalize_zip(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "z string").select(text.normalize_zip(F.col("z")).alias("z")).first().z == want


def test_column_lookup():
    assert text.find_column(["Postal_Code", "LAT", "Longitude "], text.ZIP_NAMES) == "Postal_Code"
    assert text.find_column(["x"], text.LAT_NAMES) is None


@pytest.mark.parametrize("pct", [0, 100, -5])
def test_bad_percentiles_are_rejected(pct):
    with pytest.raises(ValueError):
        params.check_percentile(pct)


def test_names_and_defaults():
    assert [params.percentile_tag(p) for p in (80, 90.0, 97.5)] == ["80", "90", "97.5"]
    p = params.DetectParams(region_area_km2=1.0)
    assert (p.min_pixels, p.min_duration, p.grace_days) == (1563, 3, 1)
    assert params.MEASURES["hi"].index_name == "HSCI-H"
    columns = output_columns()
    assert len(columns) == len(set(columns)) == 91
