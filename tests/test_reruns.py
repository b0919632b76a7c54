"""Runs that die, days that come later, files that change: the rows of an undisturbed run."""

import datetime as dt
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_jobs import CELL_DDL, MAY, NX, NY, bil_zip, cells_of, filled, mags, weather

from swelter.params import DetectParams
from swelter.plans import detect as detect_job
from swelter.plans.build import add_cells, build, ingest_rasters
from swelter.plans.detect import detect
from swelter.session import cut_lineage
from swelter.sources.store import Store
from swelter.streaming.intake import watch_cell_days

SMALL = DetectParams(region_area_km2=16.0, pixel_size_km=1.0, min_area_km2=1, hull_gate_km2=1, min_hot_cells=1, cluster_cutoff_km=1.2, min_duration=1, tile=14)
PRODUCTS = ("hw_day", "excd", "cluster_event", "event_summary", "event_merge")


class Died(Exception):
    pass


def rows_of(store, *names):
    return {n: sorted(map(str, store.read(n).select(*sorted(store.read(n).columns)).collect())) for n in names}


def dying(monkeypatch, at, after):
    """Let the ``at``-th change of a table or manifest fail, before anything is written or when
    rows are but the pointer is not."""
    count = {"n": 0}
    plain = {n: getattr(Store, n) for n in ("_commit", "save_manifest", "drop_manifest")}

    def step(name):
        def run(self, *args, **kwargs):
            if (name == "save_manifest") == after:
                count["n"] += 1
                if count["n"] == at:
                    raise Died
            return plain[name](self, *args, **kwargs)

        return run

    for name in plain:
        monkeypatch.setattr(Store, name, step(name))
    return lambda: [monkeypatch.setattr(Store, n, f) for n, f in plain.items()]


def copied(spark, store, root):
    import shutil

    shutil.copytree(store.root, root)
    return Store(spark, str(root))


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """A store with five of six days built, all six days of cells, and what a build gives then."""
    rows = cells_of(MAY)
    store = filled(spark, tmp_path_factory.mktemp("grown"), [x for x in rows if x[0] != MAY[2]])
    build(store, [80], ["t"])
    before = len(mags(store))
    add_cells(store, spark.createDataFrame(rows, CELL_DDL))
    whole = copied(spark, store, tmp_path_factory.mktemp("whole") / "x")
    build(whole, [80], ["t"])
    return store, before, rows_of(whole, "mag", "mag_calendar", "threshold")


@pytest.mark.parametrize("after", [False, True])
def test_build_that_dies_loses_nothing(spark, grown, tmp_path, monkeypatch, after):
    store, before, want = grown
    for at in range(1, 6):
        mine = copied(spark, store, tmp_path / f"{at}")
        undo = dying(monkeypatch, at, after)
        try:
            build(mine, [80], ["t"])
            ended = True
        except Died:
            ended = False
        undo()
        assert len(mags(mine)) >= before
        build(mine, [80], ["t"])
        assert rows_of(mine, "mag", "mag_calendar", "threshold") == want
        if ended:
            break
    assert ended and at > 2


def test_first_build_and_detect_that_die(spark, grown, tmp_path, monkeypatch):
    store = copied(spark, grown[0], tmp_path / "whole")
    build(store, [80], ["t"])
    detect(store, SMALL, [80], ["t"])
    want = rows_of(store, *PRODUCTS)
    assert want["hw_day"] and want["excd"]
    for at in (4, 8):
        mine = copied(spark, grown[0], tmp_path / f"{at}")
        detect(mine, SMALL, [80], ["t"])  # five days
        build(mine, [80], ["t"])
        undo = dying(monkeypatch, at, False)
        with pytest.raises(Died):
            detect(mine, SMALL, [80], ["t"])
        undo()
        assert detect(mine, SMALL, [80], ["t"]) and not detect(mine, SMALL, [80], ["t"])
        assert rows_of(mine, *PRODUCTS) == want


def test_pointer_names_the_rows(spark, tmp_path):
    """A write without its pointer is not seen and swept away; a plan made before a write still runs after it."""
    store = Store(spark, str(tmp_path))
    make = lambda *rows: spark.createDataFrame(rows, "measure string, pct double, d date, n long")
    a, b = ("t", 80.0, MAY[0], 1), ("hi", 80.0, MAY[0], 2)
    store.write("mag_calendar", make(a, b))
    early = store.read("mag_calendar")
    store.write("mag_calendar", make(("t", 80.0, MAY[0], 3)))
    assert sorted(r.n for r in early.collect()) == [1, 2] and sorted(r.n for r in store.read("mag_calendar").collect()) == [2, 3]
    stray = f"{store.path('mag_calendar')}/measure=t/pct=80.0/_v=0stray"
    make(a).drop("measure", "pct").write.parquet(stray)
    assert sorted(r.n for r in store.read("mag_calendar").collect()) == [2, 3]
    store.replace_series("mag_calendar", make(), [("hi", 80)])
    assert not os.path.exists(stray) and [r.n for r in store.read("mag_calendar").collect()] == [3]
    for k in range(20):
        store.append("mag_calendar", make(("t", 80.0, MAY[1], 10 + k)))
    assert sorted(r.n for r in store.read("mag_calendar").collect()) == [3, *range(10, 30)]
    assert len(store.pointer("mag_calendar")["parts"]["measure=t/pct=80.0"]) < 16
    store.replace("mag_calendar", make())
    assert store.read("mag_calendar").collect() == [] and store.read("mag_calendar").columns == ["d", "n", "measure", "pct"]
    os.makedirs(store.path("threshold") + "/measure=t")
    with pytest.raises(ValueError, match="older version"):
        store.exists("threshold")


DAYS = [dt.date(2020, 6, 1) + dt.timedelta(days=k) for k in range(14)]


def blobs(i, r, c):
    """Two spots that grow, meet, part and vanish."""
    spread = abs(i % 8 - 4)
    near = min((r - 3) ** 2 + (c - 3 - spread) ** 2, (r - 3) ** 2 + (c - 11 + spread) ** 2, (r - 9) ** 2 + (c - 7 - i % 5) ** 2)
    return 20 + 6 * np.exp(-near / 4) + 0.01 * ((7 * i + 3 * r + c) % 5)


def test_detect_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    """A day at the end, one in the middle, one that changes: only that day is segmented, and all
    products equal those of one run over everything."""
    from swelter.operators.grid import affine_axis

    def fresh(root, rows):
        store = Store(spark, str(tmp_path / root))
        store.write_axes(affine_axis(spark, 12, 35.0, -0.01), affine_axis(spark, 16, -90.0, 0.01))
        add_cells(store, spark.createDataFrame(rows, CELL_DDL))
        # one threshold for all runs, so a day does not change what the others exceed
        cells = [(m, 80.0, 6, r, c, 22.0) for m in ("t",) for r in range(12) for c in range(16)]
        store.write("threshold", spark.createDataFrame(cells, "measure string, pct double, month int, r int, c int, thr float"))
        build(store, [80], ["t"])
        return store

    rows = cells_of(DAYS, blobs, 12, 16)
    last, middle = DAYS[-1], DAYS[5]
    seen = []
    plain = detect_job.segment_days
    monkeypatch.setattr(detect_job, "segment_days", lambda mag, *a: (seen.append({x.d for x in mag.select("d").distinct().collect()}), plain(mag, *a))[1])
    store = fresh("parts", [x for x in rows if x[0] not in (last, middle)])
    detect(store, SMALL, [80], ["t"])
    first = rows_of(store, "cluster_event")
    for day in (last, middle):
        add_cells(store, spark.createDataFrame([x for x in rows if x[0] == day], CELL_DDL))
        build(store, [80], ["t"])
        assert detect(store, SMALL, [80], ["t"]) and seen[-1] == {day}
    whole = fresh("whole", rows)
    detect(whole, SMALL, [80], ["t"])
    assert len(seen[-1]) == len(DAYS) and rows_of(store, *PRODUCTS) == rows_of(whole, *PRODUCTS) and rows_of(store, "cluster_event") != first
    assert whole.read("event_merge").count() > 0 and whole.read("hw_day").agg(F.sum("n_splits")).first()[0] > 0

    # an unchanged run reads neither exceedances nor segments
    names = []
    read = Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, *a: (names.append(name), read(self, name, *a))[1])
    assert not detect(store, SMALL, [80], ["t"]) and set(names) == {"mag_calendar"}
    monkeypatch.setattr(Store, "read", read)

    # a corrected day, and then parameters that are used for linking alone
    warmer = [(d, r, c, hi + 1.5, t + 1.5) for d, r, c, hi, t in rows if d == middle]
    for each in (store, whole):
        add_cells(each, spark.createDataFrame(warmer, CELL_DDL))
        build(each, [80], ["t"])
    for s in detect_job.SEGMENTS:  # so that the second store does everything anew
        whole.replace(s, whole.read(s).where("false"))
    whole.replace("seg_calendar", whole.read("seg_calendar").where("false"))
    whole.drop_manifest("detect_t_80")
    for grace in (1, 0):
        from dataclasses import replace

        params = replace(SMALL, min_duration=2, grace_days=grace)
        detect(store, params, [80], ["t"])
        assert seen[-1] == ({middle} if grace else set(DAYS))
        detect(whole, params, [80], ["t"])
        assert rows_of(store, *PRODUCTS) == rows_of(whole, *PRODUCTS)


def test_later_file_wins(spark, tmp_path):
    rows = cells_of(MAY[:2])
    store = filled(spark, tmp_path / "p", rows)
    other = [(d, r, c, hi + 5, t + 5) for d, r, c, hi, t in rows if d == MAY[1] and r == 0]
    timed = spark.createDataFrame(other, CELL_DDL)
    old = timed.withColumn("as_of", F.lit("2001-01-01").cast("timestamp"))
    add_cells(store, old)
    assert sorted(map(tuple, store.read("cell_day").select("d", "r", "c", "hi", "t2").collect())) == sorted(rows)
    before = {x.d: x.cells for x in store.read("calendar").collect()}
    twice = timed.unionByName(timed.withColumn("hi", F.col("hi") - 1))  # equally late: the larger
    add_cells(store, twice)
    want = sorted([x for x in rows if not (x[0] == MAY[1] and x[1] == 0)] + other)
    assert sorted(map(tuple, store.read("cell_day").select("d", "r", "c", "hi", "t2").collect())) == want
    after = {x.d: x.cells for x in store.read("calendar").collect()}
    assert after[MAY[0]] == before[MAY[0]] and after[MAY[1]] != before[MAY[1]]


def test_second_intake_decodes_nothing_and_corrections_are_read(spark, tmp_path, monkeypatch):
    from swelter.sources import rasters

    for name in ("t", "td"):
        (tmp_path / name).mkdir()
        for i, d in enumerate(MAY[:3]):
            (tmp_path / name / f"{name}_{d:%Y%m%d}.zip").write_bytes(bil_zip(weather(i) - 5 * (name == "td")))
    (tmp_path / "td" / f"td_{MAY[2]:%Y%m%d}.zip").unlink()
    (tmp_path / "t" / f"t_{MAY[3]:%Y%m%d}.zip").write_bytes(b"broken")
    store = Store(spark, str(tmp_path / "p"))
    taken = []
    plain = rasters.read_pairs
    plan = {}
    monkeypatch.setattr(rasters, "read_pairs", lambda spark, pairs, glob: (taken.append(sorted(x.d for x in pairs.collect())), plan.setdefault("x", plain(spark, pairs, glob)))[1])
    again = lambda: [x.path for x in ingest_rasters(store, str(tmp_path / "t"), str(tmp_path / "td")).collect()]
    failed = again()
    assert len(failed) == 1 and failed[0].endswith("0504.zip") and taken[-1] == MAY[:4]
    # files are brought together by day; cells leave the task as they are decoded
    text = plan["x"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text[: text.index("MapInArrow")]
    plan.clear()
    assert store.read("cell_day").select("d").distinct().count() == 2 and store.read("calendar").count() == 4
    assert again() == failed and taken[-1] == [MAY[3]]  # only the broken file is tried again
    time.sleep(0.01)
    (tmp_path / "td" / f"td_{MAY[2]:%Y%m%d}.zip").write_bytes(bil_zip(weather(2) - 5))
    (tmp_path / "t" / f"t_{MAY[0]:%Y%m%d}.zip").write_bytes(bil_zip(weather(0) + 3))
    (tmp_path / "td" / f"td_{MAY[3]:%Y%m%d}.zip").write_bytes(bil_zip(weather(3) - 5))
    (tmp_path / "t" / f"t_{MAY[3]:%Y%m%d}.zip").write_bytes(bil_zip(weather(3)))
    plan.clear()
    assert again() == [] and taken[-1] == [MAY[0], MAY[2], MAY[3]]
    count = len(taken)
    assert again() == [] and len(taken) == count
    cells = store.read("cell_day")
    assert cells.count() == 4 * NY * NX
    assert np.isclose(cells.where((F.col("d") == MAY[0]) & (F.col("r") == 2) & (F.col("c") == 3)).first().t2, weather(0)[2, 3] + 3, atol=1e-4)


def test_stream_takes_the_later_file(spark, tmp_path):
    store = Store(spark, str(tmp_path / "p"))
    rows = cells_of(MAY[:1])
    for k, part in enumerate((rows, [(d, r, c, hi + 1, t + 1) for d, r, c, hi, t in rows])):
        spark.createDataFrame(part, CELL_DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
        time.sleep(1.1)
    watch_cell_days(store, str(tmp_path / "inbox"), str(tmp_path / "ckpt"), [80], max_files=1)
    assert sorted(x.t2 for x in store.read("cell_day").collect()) == sorted(x[4] + 1 for x in rows)
    assert cut_lineage(store.read("mag_calendar")).count() == 2
