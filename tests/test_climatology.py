import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter.operators import climatology as c
from swelter.operators import summary


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(0, 800, 3):
        d = dt.date(2020, 1, 1) + dt.timedelta(days=k)
        for r in range(2):
            for col in range(3):
                hi, t = rng.normal(30, 4), round(rng.normal(28, 3), 1)
                rows.append((d, r, col, None if rng.random() < 0.1 else float(np.float32(hi)), float(t)))
    return spark.createDataFrame(rows, "d date, r int, c int, hi float, t2 float"), rows


def test_percentile_matches_midpoint_rule(spark):
    rng = np.random.default_rng(0)
    groups = {g: rng.normal(size=n) for g, n in enumerate((1, 2, 3, 10, 97))}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(9, None), (1, float("nan"))]
    got = c.hazen_percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", [1, 50, 90, 99]).collect()
    assert len(got) == 6 * 4
    for row in got:
        if row.g == 9:
            assert row.q is None and row.n == 0
        else:
            assert row.q == pytest.approx(np.percentile(groups[row.g], row.pct, method="hazen"), abs=1e-12)


def test_exceedances_match_row_at_a_time(cells):
    df, rows = cells
    want = {}
    for measure, at in (("hi", 3), ("t", 4)):
        for pct in (80.0, 95.0):
            for month in range(5, 10):
                for cell in {(x[1], x[2]) for x in rows}:
                    mine = [x for x in rows if x[0].month == month and (x[1], x[2]) == cell and x[at] is not None]
                    if not mine:
                        continue
                    thr = np.float32(np.percentile(np.array([x[at] for x in mine], np.float32).astype(float), pct, method="hazen"))
                    for x in mine:
                        mag = np.float32(x[at]) - thr
                        if mag > 0:
                            want[measure, pct, x[0], *cell] = float(mag)
    fused = {tuple(r[:5]): r.mag for r in c.exceedance_fused(df, [80, 95]).collect()}
    stored = {tuple(r[:5]): r.mag for r in c.exceedance_against(df, c.monthly_threshold(df, [80, 95])).collect()}
    assert fused == stored
    assert fused.keys() == want.keys()
    assert all(abs(fused[k] - want[k]) < 1e-5 for k in want)


def test_one_shuffle_of_the_cube(cells):
    plan = c.exceedance_fused(cells[0], [80, 90, 95])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_missing_days(spark, cells):
    df = cells[0]
    wanted = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2020, 1, 2),)], "d date")
    assert [r.d for r in c.missing_days(wanted, df).collect()] == [dt.date(2020, 1, 2)]


def test_accumulated_index(spark):
    rows = [
        ("t", 90.0, dt.date(2020, 5, 30), 1.0), ("t", 90.0, dt.date(2020, 5, 31), 0.0), ("t", 90.0, dt.date(2020, 6, 1), None),
        ("t", 90.0, dt.date(2021, 5, 1), 2.5), ("t", 90.0, dt.date(2021, 6, 1), float("inf")),
    ]
    df = spark.createDataFrame(rows, "measure string, pct double, d date, hsci double")
    year = summary.accumulate_hsci(df).orderBy("year").collect()
    assert [(r.year, r.ahsci, r.heatwave_days) for r in year] == [(2020, 1.0, 1), (2021, 2.5, 1)]
    moy = summary.accumulate_hsci(df, "month-of-year").collect()
    assert [(r.month_number, r.month, r.ahsci) for r in moy] == [(5, "May", 3.5)]
    assert summary.accumulate_hsci(df, "month").count() == 2
    assert summary.hsci_series(df).count() == 3
    with pytest.raises(ValueError):
        summary.accumulate_hsci(df, "week")
