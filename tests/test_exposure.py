import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter.operators import exposure as ex
from swelter.operators import quantiles as qt
from swelter.operators import zips
from swelter.params import GridShape

HW_DDL = "measure string, pct double, d date, hsci double"
NEAR = "struct<km: double, mag: float>"


def run(spark, patients, v_t, v_hi, hw, zones=("32608",), pct=95.0):
    """Features of ``(row_id, zip, admit)`` rows from day values and index days."""
    people = spark.createDataFrame(patients, "row_id long, zip string, admit date")
    ddl = "pct double, zip string, d date, v double"
    zt = spark.createDataFrame([(pct, z, d, v) for z, d, v in v_t], ddl)
    zh = spark.createDataFrame([(pct, z, d, v, (1.0, v)) for z, d, v in v_hi], f"{ddl}, near {NEAR}")
    days = spark.createDataFrame([(m, pct, d, h) for m, d, h in hw], HW_DDL)
    line = ex.zip_timeline(people, [pct], zt, zh, days.where("measure = 'hi'").select("pct", "d"))
    located = spark.createDataFrame([(z,) for z in zones], "zip string")
    out = ex.attach_exposure(people, [pct], located, ex.timeline_features(line), ex.hsci_features(days))
    return {r.row_id: r.asDict() for r in ex.intensity_features(ex.any_flags(ex.missing_flags(out))).collect()}


ADMIT = dt.date(2023, 7, 10)


def back(k):
    return ADMIT - dt.timedelta(days=k)


def test_seven_day_windows(spark):
    hw = [("t", ADMIT, 1.0), ("hi", ADMIT, 2.0)]
    hw += [("t", back(k), float(k)) for k in range(1, 8)] + [("hi", back(k), float(k + 9)) for k in range(1, 8)]
    got = run(
        spark, [(0, "32608", ADMIT)],
        [("32608", back(k), 10.0 - k) for k in range(8)], [("32608", back(k), 100.0 - k) for k in range(8)], hw,
    )[0]
    assert got["HSCI_T_admit"] == 1.0 and got["HSCI_HI_admit"] == 2.0
    assert got["HSCI_T_1d_prior"] == 1.0 and got["HSCI_HI_2d_prior"] == 21.0
    assert got["days_excd_T_6d_prior"] == got["days_excd_HI_6d_prior"] == 6
    assert got["max_excd_T_6d_prior"] == 9.0 and got["max_excd_HI_6d_prior"] == 99.0
    assert got["zcta_EXCD_T_admit"] == 10.0 and got["zcta_EXCD_T_3d_prior"] == 24.0
    assert got["excd_T_recent_intensity"] == 8.0 and got["nearest_hw_back_days_HI_admit_nan"] is None


def test_domain_and_local_days(spark):
    admit = dt.date(2023, 7, 15)
    day = lambda k: admit + dt.timedelta(days=k)
    got = run(
        spark, [(0, "32608", admit), (1, "32608", day(-27)), (2, "32608", day(28))],
        [], [("32608", day(-k), 1.5) for k in (1, 2, 3, 4)],
        [("hi", day(-1), 3.0), ("hi", day(-2), float("nan")), ("hi", day(-10), 3.0)],
    )
    assert got[0]["days_heatwave_HI_30d_prior"] == 2 and got[0]["days_excd_HI_30d_prior"] == 4
    assert got[0]["days_excd_HI_3d_prior"] == 3
    assert got[0]["HSCI_HI_30d_prior"] == 6.0
    assert got[1]["days_excd_HI_30d_prior"] == 0
    assert got[2]["days_excd_HI_30d_prior"] == 2 and got[2]["days_heatwave_HI_30d_prior"] == 2


@pytest.mark.parametrize(
    ("hot", "want"), [((0, 1, 2, 3), 3), ((1, 2, 3), 3), ((1, 3, 4), 3), ((1, 4, 5), 1), ((2, 3), 2), ((3, 4), 0), ((), 0), ((30, 31), 0)]
)
def test_anchored_streak(spark, hot, want):
    got = run(spark, [(0, "32608", ADMIT)], [], [("32608", back(k), 1.0) for k in hot], [])
    assert got[0]["event_duration_HI_admit_anchor"] == want


def test_streak_equals_backward_scan(spark):
    rng = np.random.default_rng(4)
    rows = [(i, sorted((np.flatnonzero(rng.random(30) < rng.choice([0.2, 0.7, 0.95])) + 1).tolist())) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, b array<int>")
    for grace in (0, 1, 3):
        got = {r.i: r.n for r in df.select("i", ex.streak_with_grace(F.col("b"), grace).alias("n")).collect()}
        for i, hot in rows:
            count = used = 0
            for k in range(1, 31):
                if k in hot:
                    count += 1
                elif used < grace:
                    used += 1
                else:
                    break
            assert got[i] == count


def test_missing_rules(spark):
    hw = [("t", ADMIT, 5.0), ("hi", back(2), 4.0)]
    got = run(
        spark,
        [(0, "32608", ADMIT), (1, "99999", ADMIT), (2, "32608", None), (3, None, ADMIT), (4, "32608", back(1))],
        [("32608", back(3), 2.0)], [("32608", back(5), 7.0)], hw,
    )
    located, unlocated, undated, no_zip, day_off = (got[i] for i in range(5))
    assert located["zcta_EXCD_T_admit"] is None and day_off["zcta_EXCD_T_admit"] == 0.0
    assert located["miss_excd_T_admit"] == 1.0 and located["any_excd_T_admit"] == 0.0 and located["any_heat_T_admit"] == 1.0
    assert located["nearest_hw_back_days_HI_admit_nan"] == 5.0 and located["nearest_hw_excd_HI_admit_nan"] == 7.0
    assert located["max_excd_HI_3d_prior"] == 0.0 and located["days_excd_HI_5d_prior"] == 1.0
    for row in (unlocated, no_zip):
        assert row["HSCI_HI_2d_prior"] == 4.0 and row["HSCI_T_admit"] == 5.0
        assert row["days_excd_HI_7d_prior"] is None and row["zcta_EXCD_T_7d_prior"] is None
        assert row["miss_excd_HI_admit"] == 1.0 and row["event_duration_HI_admit_anchor"] is None
    assert undated["HSCI_HI_30d_prior"] is None and undated["miss_excd_T_admit"] is None and undated["any_heat_T_admit"] == 0.0


def test_no_explosion_of_admissions(spark):
    """A hot ZIP and date is computed once, however many admissions share it."""
    people = spark.range(5000).select(F.col("id").alias("row_id"), F.lit("32608").alias("zip"), F.lit(ADMIT).alias("admit"))
    zt = spark.createDataFrame([(95.0, "32608", back(1), 1.0)], "pct double, zip string, d date, v double")
    zh = spark.createDataFrame([(95.0, "32608", back(1), 1.0, (0.5, 1.0))], f"pct double, zip string, d date, v double, near {NEAR}")
    days = spark.createDataFrame([("hi", 95.0, back(1), 1.0)], HW_DDL)
    line = ex.zip_timeline(people, [95.0], zt, zh, days.select("pct", "d"))
    assert line.count() == 2
    zones = spark.createDataFrame([("32608",)], "zip string")
    out = ex.attach_exposure(people, [95.0], zones, ex.timeline_features(line), ex.hsci_features(days))
    assert out.where("days_excd_HI_1d_prior = 1").count() == 5000


def test_zip_windows_and_daily_means(spark):
    axis = lambda n: spark.range(n).select(F.col("id").cast("int").alias("idx"), F.col("id").cast("double").alias("coord"))
    raw = spark.createDataFrame([("1.0", "0.2", 3.4), ("2", "2.5", 1.5), ("3", "x", 1.0), ("2", "1.0", 1.0)], "`ZIP Code` string, Lat string, LONG double")
    cen = zips.zip_centroids(raw.withColumn("row_id", F.monotonically_increasing_id()))
    win = zips.zip_window(zips.last_per_zip(cen, "row_id"), axis(4), axis(5), GridShape(4, 5), 1)
    got = {r.zip: (r.r0, r.r1, r.c0, r.c1) for r in win.collect()}
    assert got == {"00001": (0, 1, 2, 4), "00002": (0, 2, 0, 2)}
    cells = zips.window_cells(win, axis(4), axis(5))
    mag = spark.createDataFrame(
        [(90.0, ADMIT, 0, 2, 2.0), (90.0, ADMIT, 1, 4, 4.0), (90.0, ADMIT, 3, 3, 9.0), (90.0, ADMIT, 1, 3, -1.0)],
        "pct double, d date, r int, c int, mag float",
    )
    day = {r.zip: r for r in zips.zip_day(mag, cells, nearest=True).collect()}
    assert day["00001"].v == 3.0 and day["00001"].near.mag == 4.0 and day["00002"].v == 2.0


@pytest.mark.parametrize("accuracy", [20000, 200])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(1)
    data = {80.0: np.round(rng.gamma(2, 2, 6000), 2), 90.0: rng.gamma(2, 2, 3), 95.0: np.full(4000, 1.5)}
    rows = [(p, float(v), None if i % 3 else float(v * 2)) for p, vs in data.items() for i, v in enumerate(vs)]
    rows += [(80.0, -1.0, 0.0), (99.0, 0.0, None)]
    df = spark.createDataFrame(rows, "pct double, a double, b double")
    probs = [1 / 3, 2 / 3, 0.9]
    got = qt.positive_quantiles(df, ["pct"], ["a", "b"], probs, accuracy).collect()
    assert {r.pct for r in got} == {80.0, 90.0, 95.0}
    for r in got:
        vals = [x[1 if r.name == "a" else 2] for x in rows if x[0] == r.pct]
        vals = [v for v in vals if v is not None and v > 0]
        assert r.q == pytest.approx(np.quantile(vals, r.p), abs=1e-12)


def test_flags_and_categories(spark):
    rows = [(90.0, v) for v in (None, 0.0, 1.0, 2.0, 3.0, 4.0)] + [(95.0, 0.0), (95.0, None)]
    df = spark.createDataFrame(rows, "pct double, v double")
    got = qt.with_quantile_features(df, ["pct"], {"v": "extreme"}, {"v": "cat"}).collect()
    assert {(r.pct, r.v): (r.extreme, r.cat) for r in got} == {
        (90.0, None): (0.0, "missing"), (90.0, 0.0): (0.0, "none"), (90.0, 1.0): (0.0, "low"), (90.0, 2.0): (0.0, "low"),
        (90.0, 3.0): (0.0, "moderate"), (90.0, 4.0): (1.0, "high"), (95.0, 0.0): (0.0, "none"), (95.0, None): (0.0, "missing"),
    }
