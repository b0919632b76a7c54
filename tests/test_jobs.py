"""Files in, products out: the whole chain on a small invented grid."""

import datetime as dt
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from swelter import __main__ as cli
from swelter.operators.grid import affine_axis
from swelter.params import DetectParams
from swelter.plans.append import append, output_columns
from swelter.plans.build import build, ingest_cache, ingest_rasters
from swelter.plans.detect import detect
from swelter.plans.summarise import summarise
from swelter.sources import rasters, tables
from swelter.sources.store import Store
from swelter.streaming.intake import watch_cell_days

NY, NX = 24, 30
DAYS = [dt.date(2020 + y, m, 1) + dt.timedelta(days=k) for y in range(2) for m in (6, 7) for k in range(20)]
PARAMS = DetectParams(
    region_area_km2=1000.0, pixel_size_km=1.0, min_area_km2=10, hull_gate_km2=15, min_hot_cells=20, cluster_cutoff_km=6.0,
    min_duration=2, tile=14,
)


def weather(i):
    """A warm blob that grows and wanders, so that hot days come in spells."""
    rng = np.random.default_rng(i)
    r, c = np.indices((NY, NX))
    spell = max(0.0, np.sin(i / 3.0))
    blob = 8 * spell * np.exp(-(((r - 8 - i % 7) / 5.0) ** 2 + ((c - 12) / 7.0) ** 2))
    return (24 + blob + rng.normal(0, 0.3, (NY, NX))).astype(np.float32)


def bil_zip(img, nodata=-9999.0):
    header = (
        f"BYTEORDER I\nLAYOUT BIL\nNROWS {NY}\nNCOLS {NX}\nNBANDS 1\nNBITS 32\nPIXELTYPE FLOAT\n"
        f"ULXMAP -90.0\nULYMAP 35.0\nXDIM 0.01\nYDIM 0.01\nNODATA {nodata}\n"
    )
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.bil", np.asarray(img, "<f4").tobytes())
        z.writestr("a.hdr", header)
    return buf.getvalue()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name in ("t", "td"):
        (root / name).mkdir()
    for i, d in enumerate(DAYS[:3]):
        img = weather(i)
        img[0, 0] = -9999
        (root / "t" / f"tmax_us_30s_{d:%Y%m%d}.zip").write_bytes(bil_zip(img))
        (root / "td" / f"tdmean_us_30s_{d:%Y%m%d}.zip").write_bytes(bil_zip(weather(i) - 5))
    (root / "t" / "tmax_us_30s_20200801.zip").write_bytes(b"not a zip")
    cache = root / "cache"
    cache.mkdir()
    for i, d in enumerate(DAYS[:60]):
        np.savez(cache / f"HI_{d:%Y%m%d}.npz", HI=weather(i) + 1, T2=weather(i), tvar=np.array("tmax"))
    np.savez(cache / "HI_20200901.npz", HI=weather(1), T2=weather(1), tvar=np.array("tmean"))
    np.savez(cache / "HI_20200902.npz", HI=weather(1), tvar=np.array("tmax"))
    return Store(spark, str(root))


def test_intake_of_rasters_and_caches(store):
    failed = ingest_rasters(store, f"{store.root}/t", f"{store.root}/td").collect()
    assert len(failed) == 1 and "20200801" in failed[0].path
    shape = store.shape()
    assert (shape.ny, shape.nx) == (NY, NX)
    assert store.axes()[0].where("idx = 0").first().coord == pytest.approx(35.0, abs=1e-4)
    cells = store.read("cell_day")
    assert cells.count() == 3 * NY * NX - 3  # one missing cell a day
    failed = ingest_cache(store, f"{store.root}/cache").collect()
    assert sorted(f.path[-12:-4] for f in failed) == ["20200901", "20200902"]
    assert "tmean" in {f.path[-12:-4]: f.error for f in failed}["20200901"]
    cells = store.read("cell_day")
    assert cells.select("d").distinct().count() == 60
    assert cells.groupBy("d", "r", "c").count().where("count > 1").isEmpty()


def test_build_resumes_with_new_days(store, spark):
    build(store, [80])
    first = store.read("mag").count()
    assert first > 0 and store.read("mag_calendar").count() == 126
    build(store, [80])
    assert store.read("mag").count() == first and store.read("mag_calendar").count() == 126
    inbox = f"{store.root}/inbox"
    rows = [(d, r, c, float(weather(i)[r, c] + 1), float(weather(i)[r, c])) for i, d in list(enumerate(DAYS))[60:] for r in range(NY) for c in range(NX)]
    spark.createDataFrame(rows, "d date, r int, c int, hi float, t2 float").write.parquet(inbox)
    for _ in range(2):  # the second run finds nothing new
        q = watch_cell_days(store, inbox, f"{store.root}/_inbox_checkpoint", [80])
        q.awaitTermination(300)
        assert q.exception() is None
        assert store.read("cell_day").select("d").distinct().count() == 80
        assert store.read("mag_calendar").count() == 166
    mag = store.read("mag")
    assert mag.groupBy("measure", "pct", "d", "r", "c").count().where("count > 1").isEmpty()
    thr = store.read("threshold").where("measure = 't'")
    cells = store.read("cell_day").select("d", "r", "c", "t2", "month")
    want = cells.join(thr.select("month", "r", "c", "thr"), ["month", "r", "c"]).where("t2 > thr").count()
    assert mag.where("measure = 't'").count() == want


def test_detect_products(store):
    assert detect(store, PARAMS, [80])
    hw, excd, linked = store.read("hw_day"), store.read("excd"), store.read("cluster_event")
    for measure in ("t", "hi"):
        days = hw.where(F.col("measure") == measure).orderBy("d").collect()
        assert len(days) >= 4 and [r.pos for r in days] == list(range(len(days)))
        assert all(r.hsci > 0 and r.area_km2 > 15 and 0 < r.prop_hw <= 1 and r.n_clusters >= 1 for r in days)
    assert hw.schema["hsci"].dataType.simpleString() == "float"
    assert linked.groupBy("measure", "d").count().join(hw, ["measure", "d"]).where("count <> n_clusters").isEmpty()
    raw = store.read("mag").select("measure", "pct", "d", "r", "c", "mag")
    inside = excd.select(*raw.columns)
    assert 0 < inside.count() and inside.exceptAll(raw).isEmpty()
    assert inside.select("measure", "d").distinct().count() == hw.count()
    assert not detect(store, PARAMS, [80])  # same days and parameters
    assert store.load_manifest("detect_t_80")["min_area_km2"] == 10
    csv = store.spark.read.csv(store.path("csv/t_80/events"), header=True)
    assert csv.columns == ["event_id", "duration_days", "distinct_days"]


def look_back_by_hand(store, zip_cell, admit, k):
    """Days of the last ``k`` with any exceeding HI cell in the 3 x 3 window, from the raw table."""
    r, c = zip_cell
    near = store.read("mag").where((F.col("measure") == "hi") & F.col("r").between(r - 1, r + 1) & F.col("c").between(c - 1, c + 1))
    values = {}
    for row in near.collect():
        values.setdefault(row.d, []).append(row.mag)
    hot = [d for d in values if 1 <= (admit - d).days <= k]
    return len(hot), max((float(np.mean(values[d], dtype=np.float64)) for d in hot), default=0.0)


def test_append_and_summarise(store, spark, tmp_path):
    people = tmp_path / "patients.csv"
    people.write_text(
        "Unnamed: 0,zip5,ADMIT_DATE,DISCHARGE_DATE,age\n"
        "0, 00501 ,2020-07-12,2020-07-20,44\n1,00501,7/12/2020,7/11/2020,45\n2,00777,2020-07-12,,46\n"
        "3,00501,unknown,2020-07-12,47\n4,00502,2021-06-15,2021-06-16,48\n"
    )
    (tmp_path / "zips.csv").write_text("ZCTA,Latitude,Lng\n501.0,34.90,-89.87\n502,34.5,\n501,34.91,-89.88\n")
    append(store, str(people), str(tmp_path / "zips.csv"), [80])
    out = store.read("exposure")
    assert set(output_columns()) <= set(out.columns) and "Unnamed: 0" not in out.columns
    rows = out.orderBy("row_id").collect()
    assert [r.age for r in rows] == ["44", "45", "46", "47", "48"]
    days, top = look_back_by_hand(store, (9, 12), dt.date(2020, 7, 12), 7)
    assert days > 0
    assert rows[0].days_excd_HI_7d_prior == days and rows[0].max_excd_HI_7d_prior == pytest.approx(top)
    assert (rows[0].length_of_stay_days, rows[0].long_stay_3plus, rows[0].admit_weekday) == (8.0, 1.0, 1)
    assert (rows[1].length_of_stay_days, rows[1].invalid_length_of_stay) == (None, 1.0)
    assert rows[1].max_excd_HI_7d_prior == rows[0].max_excd_HI_7d_prior
    assert rows[2].days_excd_HI_7d_prior is None and rows[2].HSCI_T_7d_prior is not None
    assert rows[3].HSCI_T_7d_prior is None and rows[3].excd_T_admit_cat == "missing" and rows[3].heat_threshold_percentile == 80
    assert rows[4].miss_excd_HI_admit == 1.0 and rows[4].days_excd_HI_30d_prior is None
    csv = spark.read.csv(store.path("csv/exposure_80"), header=True)
    assert csv.columns == ["zip5", "ADMIT_DATE", "DISCHARGE_DATE", "age", *output_columns()]
    yearly = summarise(store, "hi", 80).collect()
    want = store.read("hw_day").where("measure = 'hi'").groupBy(F.year("d").alias("y")).agg(F.sum(F.col("hsci").cast("double")).alias("s"))
    assert {r.year: pytest.approx(r.ahsci) for r in yearly} == {r.y: r.s for r in want.collect()}
    with pytest.raises(ValueError):
        summarise(store, "hi", 99)


def test_nearest_hot_day_of_an_earlier_year(store, tmp_path):
    """The same answer whether or not an older admission stands in the file."""
    admit = dt.date(2021, 3, 10)
    (tmp_path / "z.csv").write_text("ZCTA,Latitude,Lng\n501,34.91,-89.88\n")
    near = store.read("mag").where((F.col("measure") == "hi") & (F.col("d") < admit) & F.col("r").between(8, 10) & F.col("c").between(11, 13))
    last = near.agg(F.max("d")).first()[0]
    assert last.year == 2020
    values = []
    for older in ("", "00501,2020-07-12,\n"):
        (tmp_path / "p.csv").write_text(f"zip5,ADMIT_DATE,DISCHARGE_DATE\n00501,{admit},\n{older}")
        append(store, str(tmp_path / "p.csv"), str(tmp_path / "z.csv"), [80], csv=False)
        row = store.read("exposure").orderBy("row_id").first()
        values.append([row[f"nearest_hw_{x}_HI_admit_nan"] for x in ("back_days", "space_km", "excd")])
    assert values[0][0] == (admit - last).days and None not in values[0]
    assert values[1] == values[0]


def test_patient_table_needs_a_zip(spark):
    with pytest.raises(KeyError):
        tables.prepare_patients(spark.createDataFrame([(1,)], "id int"))


def test_manifest_that_cannot_be_read(store):
    store.save_manifest("broken", {"a": 1})
    assert store.is_current("broken", {"a": 1}) and not store.is_current("broken", {"a": 2})
    from pathlib import Path

    Path(store._versions("broken")[0].removeprefix("file:")).write_text("{cut off")
    assert store.load_manifest("broken") is None and store.load_manifest("absent") is None


def test_raster_bytes():
    img = np.arange(NY * NX, dtype=np.float32).reshape(NY, NX)
    img[2, 3] = -9999
    out = rasters.decode_archive(bil_zip(img))
    assert np.isnan(out[2, 3]) and out[5, 5] == img[5, 5]
    with pytest.raises(FileNotFoundError):
        buf = io.BytesIO()
        zipfile.ZipFile(buf, "w").close()
        rasters.decode_archive(buf.getvalue())


def test_axis_from_transform(spark):
    got = [r.coord for r in affine_axis(spark, 3, 35.005, -0.01).orderBy("idx").collect()]
    assert got == pytest.approx([35.0, 34.99, 34.98], abs=1e-5)


def test_command_line(store, capsys):
    args = cli.parser().parse_args(["detect", "--root", "x", "--region-area-km2", "5", "--grace-days", "2", "--pct", "80", "97.5"])
    assert (args.region_area_km2, args.grace_days, args.pct, args.measure) == (5.0, 2, [80.0, 97.5], ["t", "hi"])
    cli.main(["inspect", store.path("threshold")])
    assert "thr float" in capsys.readouterr().out


def cells_of(days, value=lambda i, r, c: 20.0 + (i * 7 + r + c) % 11, ny=4, nx=4):
    return [(d, r, c, float(value(i, r, c) + 1), float(value(i, r, c))) for i, d in enumerate(days) for r in range(ny) for c in range(nx)]


CELL_DDL = "d date, r int, c int, hi float, t2 float"


def filled(spark, root, rows):
    from swelter.plans.build import add_cells

    store = Store(spark, str(root))
    store.write_axes(affine_axis(spark, 4, 35.0, -0.01), affine_axis(spark, 4, -90.0, 0.01))
    add_cells(store, spark.createDataFrame(rows, CELL_DDL))
    return store


def mags(store):
    return sorted((x.measure, x.pct, x.d, x.r, x.c, x.mag) for x in store.read("mag").collect())


MAY = [dt.date(2020, 5, 1) + dt.timedelta(days=k) for k in range(6)]
JUNE = [dt.date(2020, 6, 1) + dt.timedelta(days=k) for k in range(6)]


def test_two_builds_equal_one(spark, tmp_path):
    """A month added later gets thresholds of its own."""
    from swelter.plans.build import add_cells

    rows = cells_of(MAY + JUNE)
    whole = filled(spark, tmp_path / "one", rows)
    build(whole, [80])
    parts = filled(spark, tmp_path / "two", [x for x in rows if x[0] in MAY])
    build(parts, [80])
    add_cells(parts, spark.createDataFrame([x for x in rows if x[0] in JUNE], CELL_DDL))
    build(parts, [80])
    assert mags(parts) == mags(whole) and {x[2].month for x in mags(parts)} == {5, 6}


@pytest.mark.parametrize("files", [1, 2, None])
def test_days_spread_over_files_and_batches(spark, tmp_path, files):
    rows = cells_of(MAY)
    whole = filled(spark, tmp_path / "one", rows)
    build(whole, [80])
    for k in range(4):  # every day lies in two files
        part = [x for i, x in enumerate(rows) if i % 4 == k]
        spark.createDataFrame(part, CELL_DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
    store = Store(spark, str(tmp_path / "two"))
    store.write_axes(affine_axis(spark, 4, 35.0, -0.01), affine_axis(spark, 4, -90.0, 0.01))
    watch_cell_days(store, str(tmp_path / "inbox"), str(tmp_path / "ckpt"), [80], max_files=files)
    assert store.read("cell_day").count() == len(rows) and mags(store) == mags(whole)


def test_second_half_of_a_day_replaces_the_day(spark, tmp_path):
    from swelter.plans.build import add_cells

    rows = cells_of(MAY)
    store = filled(spark, tmp_path, [x for x in rows if x[0] != MAY[2] or x[1] < 2])
    build(store, [80])
    thr = {(x.measure, x.r, x.c): x.thr for x in store.read("threshold").collect()}
    add_cells(store, spark.createDataFrame(rows, CELL_DDL))
    for _ in range(2):
        build(store, [80])
        assert store.read("cell_day").count() == len(rows) and store.read("mag_calendar").count() == 12
        want = sorted((m, d, r, c) for d, r, c, hi, t in rows for m, v in (("hi", hi), ("t", t)) if v > thr[m, r, c])
        assert [x[:1] + x[2:5] for x in mags(store)] == want


def test_failed_day_stays_in_the_calendar(spark, tmp_path):
    store = filled(spark, tmp_path, cells_of([d for d in MAY if d != MAY[2]]))
    build(store, [80], days=spark.createDataFrame([(d,) for d in MAY], "d date"))
    days = store.read("mag_calendar").where("measure = 't'").collect()
    assert {x.d: x.n_cells for x in days} == {d: 0 if d == MAY[2] else 16 for d in MAY}


def test_wanted_days_from_a_file(spark, tmp_path):
    from swelter.plans.build import read_days

    (tmp_path / "days.csv").write_text("Date,x\n2020-05-01,1\n5/2/2020,2\nnone,3\n")
    assert sorted(x.d for x in read_days(spark, str(tmp_path / "days.csv")).collect()) == MAY[:2]


def test_loose_rasters(spark, tmp_path):
    for name in ("t", "td"):
        (tmp_path / name).mkdir()
        for i, d in enumerate(DAYS[:2]):
            with zipfile.ZipFile(io.BytesIO(bil_zip(weather(i) - 5 * (name == "td")))) as z:
                for end in ("bil", "hdr"):
                    (tmp_path / name / f"x_{d:%Y%m%d}.{end}").write_bytes(z.read(f"a.{end}"))
    (tmp_path / "t" / "x_20200620.bil").write_bytes(b"no header")
    store = Store(spark, str(tmp_path / "p"))
    failed = ingest_rasters(store, str(tmp_path / "t"), str(tmp_path / "td"), "*.bil").collect()
    assert len(failed) == 1 and store.shape() == rasters_shape() and store.read("cell_day").count() == 2 * NY * NX
    assert dt.date(2020, 6, 20) in {x.d for x in store.read("calendar").collect()}


def rasters_shape():
    from swelter.params import GridShape

    return GridShape(NY, NX)


def warmer(store):
    """The same days with other exceedances."""
    from swelter.plans.build import put_exceedances

    mag = store.read("mag").withColumn("mag", F.col("mag") + F.lit(1).cast("float"))
    put_exceedances(store, mag, store.read("mag_calendar"))


def test_reruns_replace_what_they_find(spark, tmp_path):
    """Stricter parameters leave no old row behind; changed exceedances are detected again."""
    from dataclasses import replace

    store = filled(spark, tmp_path, cells_of(MAY))
    build(store, [80], ["t"])
    small = DetectParams(region_area_km2=16.0, pixel_size_km=1.0, min_area_km2=1, hull_gate_km2=1, min_hot_cells=1, min_duration=1, tile=14)
    assert detect(store, small, [80], ["t"]) and not detect(store, small, [80], ["t"])
    first = store.read("hw_day").count()
    warmer(store)
    assert first > 0 and detect(store, replace(small, hull_gate_km2=1e9), [80], ["t"])
    for name in ("hw_day", "excd", "cluster_event", "event_summary"):
        assert store.read(name).count() == 0
    made = store.load_manifest("detect_t_80")
    warmer(store)
    assert detect(store, replace(small, hull_gate_km2=1e9), [80], ["t"]) and store.load_manifest("detect_t_80") != made


def test_percentile_that_was_never_detected(store, tmp_path):
    (tmp_path / "p.csv").write_text("zip5,ADMIT_DATE,DISCHARGE_DATE\n00501,2020-07-12,\n")
    (tmp_path / "z.csv").write_text("ZCTA,Latitude,Lng\n501,34.91,-89.88\n")
    with pytest.raises(ValueError, match="95"):
        append(store, str(tmp_path / "p.csv"), str(tmp_path / "z.csv"), [80, 95])


def test_columns_and_quotes_of_the_file_survive(store, spark, tmp_path):
    import csv

    people = tmp_path / "p.csv"
    rows = [
        ["zip5", "ADMIT_DATE", "DISCHARGE_DATE", "ZIP", "pct", "row_id", "note"],
        ["00501", "2020-07-12", "2020-07-13", "x1", "50", "7", 'said "hot" twice, left'],
        ["00501", "7/12/20", "", "x2", "60", "7", "two\nlines"], ["00502", "2020-07-14", "", "", "", "", "a\\b"],
    ]
    with people.open("w", newline="") as f:
        csv.writer(f).writerows(rows)
    (tmp_path / "z.csv").write_text("ZCTA,Latitude,Lng\n501,34.91,-89.88\n")
    append(store, str(people), str(tmp_path / "z.csv"), [80])
    from pathlib import Path

    parts = sorted(Path(store.path("csv/exposure_80")).glob("part-*.csv"))
    got = [r for p in parts for k, r in enumerate(csv.reader(p.open(newline=""))) if k or p == parts[0]]
    assert [r[:7] for r in got] == rows
    assert got[0][7:] == output_columns()


def test_rows_of_several_files_keep_their_order(spark, tmp_path):
    for name, zips in (("b", ["3", "4"]), ("a", ["1", "2"])):
        (tmp_path / f"{name}.csv").write_text("zip5,x\n" + "\n".join(f"{z},{'y' * 5000 if name == 'b' else ''}" for z in zips) + "\n")
    df = tables.prepare_patients(tables.read_csv_text(spark, str(tmp_path)))
    assert [x.zip for x in df.orderBy("row_id").collect()] == ["1", "2", "3", "4"]


def test_region_area_is_a_sum(spark, tmp_path):
    from swelter.plans.detect import region_area

    (tmp_path / "a.csv").write_text("county,Area_km2\na,10.5\nb,4.5\nc,\n")
    assert region_area(spark, str(tmp_path / "a.csv")) == 15.0
