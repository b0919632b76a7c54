"""Build: daily fields -> thresholds -> daily exceedance, resumable by day."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.functions.dates import in_season, parse_date_safe
from swelter.functions.text import find_column
from swelter.operators.climatology import (
    derive_cell_day,
    exceedance_against,
    missing_days,
    monthly_threshold,
    season_calendar,
)
from swelter.operators.grid import affine_axis
from swelter.params import SEASON_MONTHS, check_percentile
from swelter.session import cut_lineage, temporary_steps
from swelter.sources import rasters
from swelter.sources.store import Store
from swelter.sources.tables import read_csv_text

CELLS = ["d", "r", "c", "hi", "t2"]
DATE_NAMES = ("d", "date", "day", "time")
SERIES_DAY = ["measure", "pct", "d"]


def day_digest(*columns: str) -> Column:
    """A number for the rows of a group that adds up over groups: other rows give another one."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def add_cells(store: Store, df: DataFrame) -> None:
    """Store the season cells of ``df`` that are new or newer than what is stored.

    Cells, not days, are compared, so the second file of a day adds its cells, and a batch
    that comes again adds none. Of different values for one cell those with the later ``as_of``
    (time of their file; now, where ``df`` has no such column) stay, of equally late ones the
    larger. Only the months of the incoming cells are read. The calendar is written last and from
    what is stored, so a run that died in between is made good when the batch comes again.
    """
    if "as_of" not in df.columns:
        df = df.withColumn("as_of", F.current_timestamp())
    key = ["d", "r", "c"]
    latest = F.max(F.struct("as_of", "hi", "t2")).alias("x")
    season = df.where(in_season(F.col("d"), SEASON_MONTHS))
    new = cut_lineage(season.groupBy(*key).agg(latest).select(*key, "x.hi", "x.t2", "x.as_of"))
    months = _months(new)
    if not months:
        return
    if store.exists("cell_day"):
        held = store.read("cell_day", _month_parts(months))
        both = new.join(held.select(*key, *[F.col(c).alias(f"held_{c}") for c in ("hi", "t2", "as_of")], F.lit(True).alias("known")), key, "left")
        other = ~(F.col("hi").eqNullSafe(F.col("held_hi")) & F.col("t2").eqNullSafe(F.col("held_t2")))
        stale = F.col("known").isNotNull() & other & (F.col("as_of") >= F.col("held_as_of"))
        taken = cut_lineage(both.where(F.col("known").isNull() | stale).select(*new.columns, stale.alias("stale")))
        if taken.where("stale").isEmpty():
            store.append("cell_day", taken.drop("stale"))
        else:
            kept = held.select(*new.columns).join(taken, key, "left_anti")
            store.write("cell_day", cut_lineage(kept.unionByName(taken.drop("stale"))))
    else:
        store.append("cell_day", new)
    days = cut_lineage(new.select("d").distinct())
    stored = store.read("cell_day", _month_parts(months)).join(days, "d", "left_semi")
    _put_days(store, stored.groupBy("d").agg(F.count("*").alias("n_cells"), day_digest("r", "c", "hi", "t2").alias("cells")))


def _months(df: DataFrame) -> list[int]:
    """Year and month of the days in ``df`` as one number; bounded by the calendar."""
    return [x.k for x in df.select((F.year("d") * 100 + F.month("d")).alias("k")).distinct().collect()]


def _month_parts(months: Sequence[int]) -> Callable[[str], bool]:
    """Whether a partition is a folder of one of these months."""
    ends = tuple(f"year={m // 100}/month={m % 100}" for m in months)
    return lambda part: part.endswith(ends) if ends else False


def _put_days(store: Store, days: DataFrame) -> None:
    """Enter days (d, n_cells, cells) in the calendar, in place of what it says of them."""
    days = cut_lineage(days)
    if store.exists("calendar"):
        days = days.unionByName(store.read("calendar").join(days, "d", "left_anti"))
    store.replace("calendar", days)


def add_days(store: Store, days: DataFrame) -> None:
    """Days that count as observed, whether or not a cell of theirs could be read."""
    days = season_calendar(days.where("d is not null"))
    if store.exists("calendar"):
        days = missing_days(days, store.read("calendar"))
    days = cut_lineage(days.select("d", F.lit(0).cast("long").alias("n_cells"), F.lit(0).cast("decimal(38,0)").alias("cells")))
    if not days.isEmpty():
        _put_days(store, days)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """Wanted days from a CSV or Parquet table with a date column."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else read_csv_text(spark, path)
    name = find_column(raw.columns, DATE_NAMES)
    if name is None:
        raise ValueError(f"no date column among {raw.columns}")
    return raw.select(parse_date_safe(F.col(f"`{name}`").cast("string")).cast("date").alias("d")).where("d is not null")


def _note_files(store: Store, taken: DataFrame) -> None:
    """Enter files (path, kind, d, length, modified, error) in the list of files taken, in place of what it says of them."""
    taken = cut_lineage(taken)
    if store.exists("source_file"):
        taken = taken.unionByName(store.read("source_file").join(taken, ["kind", "path"], "left_anti"))
    store.replace("source_file", taken)


def failed_files(store: Store, *kinds: str) -> DataFrame:
    """path and error of all files that could not be read when last tried, in this run or an earlier one."""
    return store.read("source_file").where(F.col("kind").isin(*kinds) & F.col("error").isNotNull()).select("path", "error")


def _untaken(store: Store, listing: DataFrame) -> DataFrame:
    """Files that were not read as they are now (by size and time). Failed ones are tried again."""
    if not store.exists("source_file"):
        return listing
    same = ["kind", "path", "length", "modified"]
    return listing.join(store.read("source_file").where("error is null").select(*same), same, "left_anti")


def ingest_axes(store: Store, path: str, glob: str = "*.zip") -> None:
    """Axes from the header of a raster: for a store that is filled from caches alone."""
    rows, cols = rasters.header_axes(rasters.sample_header(store.spark, path, glob))
    store.write_axes(affine_axis(store.spark, *rows), affine_axis(store.spark, *cols))


def ingest_rasters(store: Store, t_path: str, td_path: str, glob: str = "*.zip") -> DataFrame:
    """Add days from temperature and dew point rasters; returns the files that failed.

    Files are listed first. Only days of which a file is new, or not what it was when it was
    read, are decoded: both rasters of a day in one task, so no cell is shuffled. Of several files
    of a day and kind the newest counts. A day whose file cannot be read stays in the calendar
    without cells.
    """
    spark = store.spark
    with temporary_steps(spark):
        if not store.exists("axis_row"):
            ingest_axes(store, t_path, glob)
        listed = cut_lineage(rasters.list_files(spark, t_path, glob, "t").unionByName(rasters.list_files(spark, td_path, glob, "td")))
        changed = cut_lineage(_untaken(store, listed))
        if not changed.isEmpty():
            dated = listed.where("d is not null")
            newest = F.max(F.struct("modified", "path")).alias("f")
            pairs = dated.join(changed.select("d").distinct(), "d", "left_semi").groupBy("d").pivot("kind", ["t", "td"]).agg(newest)
            pairs = cut_lineage(pairs.select("d", *[F.col(k)[x].alias(f"{k}_{x}") for k in ("t", "td") for x in ("path", "modified")]))
            decoded = cut_lineage(rasters.read_pairs(spark, pairs, glob))
            add_cells(store, derive_cell_day(rasters.good_cells(decoded).where("t is not null")))
            add_days(store, changed.where("kind = 't'").select("d"))
            errors = decoded.where("error is not null").select("kind", "path", "error")
            undated = changed.where("d is null").select("kind", "path", F.lit("ValueError: no date in the file name").alias("error"))
            _note_files(store, changed.join(errors.unionByName(undated), ["kind", "path"], "left"))
        return failed_files(store, "t", "td")


def ingest_cache(store: Store, path: str, glob: str = "HI_*.npz") -> DataFrame:
    """Add days from daily caches of an earlier installation; returns the files that failed.

    Files that were read as they are now are not read again."""
    spark = store.spark
    with temporary_steps(spark):
        changed = cut_lineage(_untaken(store, rasters.list_files(spark, path, glob, "cache")))
        if not changed.isEmpty():
            cells = cut_lineage(rasters.read_daily_cache(spark, rasters.paths_of(changed), store.tvar))
            when = changed.select("path", F.col("modified").alias("as_of"))
            add_cells(store, rasters.good_cells(cells.join(F.broadcast(when), "path")).where("hi is not null or t2 is not null"))
            add_days(store, changed.select("d"))
            _note_files(store, changed.join(rasters.failures(cells), "path", "left"))
        return failed_files(store, "cache")


def add_thresholds(store: Store, cells: DataFrame, pcts: Sequence[float], measures: Sequence[str]) -> None:
    """Thresholds of the months that have none yet; those that exist stay as they are."""
    months = [x.m for x in cells.select(F.month("d").alias("m")).distinct().collect()]
    wanted = {(m, p, k) for m in measures for p in pcts for k in months}
    if store.exists("threshold"):
        held = store.read("threshold").select("measure", "pct", "month").distinct().collect()
        wanted -= {(x.measure, x.pct, x.month) for x in held}
    if not wanted:
        return
    lacking = F.lit(False)
    for m, p, k in sorted(wanted):
        lacking = lacking | ((F.col("measure") == m) & (F.col("pct") == p) & (F.col("month") == k))
    ms, ps, ks = (sorted({w[i] for w in wanted}) for i in range(3))
    store.write("threshold", monthly_threshold(cells, ps, ms, tuple(ks)).where(lacking))


def build(
    store: Store, pcts: Sequence[float] = (80, 90, 95), measures: Sequence[str] = ("hi", "t"), days: DataFrame | None = None
) -> None:
    """Thresholds of months that have none, then exceedances of all days that lack them or have new cells.

    Existing thresholds are kept, so a day added later is compared with the climatology that
    the earlier days were compared with. Delete the threshold folder to recompute it. ``days``
    adds wanted days (column ``d``) to the calendar: a day without cells is a day without
    exceedance, not a gap that its neighbours close.
    """
    pcts = [check_percentile(p) for p in pcts]
    with temporary_steps(store.spark):
        if days is not None:
            add_days(store, days)
        cells = store.read("cell_day")
        add_thresholds(store, cells, pcts, measures)

        series = F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(p).alias("pct")) for m in measures for p in pcts])
        )
        calendar = store.read("calendar")
        wanted = calendar.select("d", "n_cells", "cells", series.alias("s")).select("s.*", "d", "n_cells", "cells")
        if store.exists("mag_calendar"):
            wanted = missing_days(wanted, store.read("mag_calendar"), (*SERIES_DAY, "n_cells", "cells"))
        wanted = cut_lineage(wanted)
        if wanted.isEmpty():
            return
        months = _months(wanted.where("n_cells > 0"))
        thr = store.read("threshold").where(
            F.col("measure").isin(*measures) & F.col("pct").isin(*pcts) & F.col("month").isin(*{m % 100 for m in months})
        )
        touched = store.read("cell_day", _month_parts(months)).select(*CELLS).join(wanted.select("d").distinct(), "d", "left_semi")
        mag = exceedance_against(touched, thr).join(wanted, SERIES_DAY, "left_semi")
        put_exceedances(store, mag, wanted)


def put_exceedances(store: Store, mag: DataFrame, wanted: DataFrame) -> None:
    """Put whole days into the store: ``wanted`` (series, d, n_cells, cells) and their exceedances.

    Finished other days of a month folder stay, the rows that these days had (or that an
    interrupted run left) go. The calendar is written last, with a digest of every day's
    exceedances: a run that dies before leaves the days marked as missing, and their folders whole.
    """
    new = cut_lineage(mag.select(*SERIES_DAY, "r", "c", "mag"))
    digest = new.groupBy(*SERIES_DAY).agg(F.count("*").alias("n_mag"), day_digest("r", "c", "mag").alias("mags"))
    noted = wanted.select(*SERIES_DAY, "n_cells", "cells").join(digest, SERIES_DAY, "left").withColumns(
        {"n_mag": F.coalesce("n_mag", F.lit(0)), "mags": F.coalesce("mags", F.lit(0).cast("decimal(38,0)"))}
    )
    noted = cut_lineage(noted)
    touched = wanted.select("measure", "pct", F.year("d").alias("year"), F.month("d").alias("month")).distinct()
    # one row per series and month
    parts = {f"measure={x.measure}/pct={x.pct}/year={x.year}/month={x.month}" for x in touched.collect()}
    if store.exists("mag_calendar"):
        done = cut_lineage(store.read("mag_calendar").join(wanted.select(*SERIES_DAY), SERIES_DAY, "left_anti"))
        kept = store.read("mag", parts.__contains__).select(*new.columns).join(done.select(*SERIES_DAY), SERIES_DAY, "left_semi")
        store.write("mag", cut_lineage(kept.unionByName(new)), parts.__contains__)
        store.write("mag_calendar", cut_lineage(done.select(*noted.columns).unionByName(noted)))
    else:
        store.replace("mag", new)
        store.replace("mag_calendar", noted)
