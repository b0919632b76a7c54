"""Detect: daily exceedance -> heat-wave days, clusters, events and the hull-restricted field."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.functions.dates import in_season
from swelter.functions.text import find_column
from swelter.operators.events import event_summary, number_days, persistent_days, resolve_events, track
from swelter.operators.hulls import restrict_to_runs, union_runs
from swelter.operators.segments import segment_days
from swelter.params import DAY_KEYS, SERIES_KEYS, DetectParams, check_percentile, percentile_tag
from swelter.session import cut_lineage, temporary_steps
from swelter.sources.store import Store, of_series
from swelter.sources.tables import read_csv_text, write_csv

AREA_NAMES = ("area_km2", "area", "region_area_km2")
HW_DAY_FLOATS = ("hsci", "area_km2", "prop_hw", "min_pair_km", "mean_pair_km", "d_mean_pair_km")


def region_area(spark: SparkSession, path: str) -> float:
    """Sum of the area column of a CSV or Parquet table, in square kilometres."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else read_csv_text(spark, path)
    name = find_column(raw.columns, AREA_NAMES)
    if name is None:
        raise ValueError(f"no area column among {raw.columns}")
    total = raw.agg(F.sum(F.expr(f"try_cast(`{name}` AS DOUBLE)"))).first()[0]
    if not total or total <= 0:
        raise ValueError(f"the areas in {path} do not add up to a region")
    return total


def _is_one_of(series: Sequence[tuple[str, float]]) -> Column:
    out = F.lit(False)
    for m, p in series:
        out = out | ((F.col("measure") == m) & (F.col("pct") == p))
    return out


def _content(store: Store, series: Sequence[tuple[str, float]]) -> dict[tuple[str, float], list[str]]:
    """Days of every series and a digest of what they hold, added up from the digests of the days: no cell is read."""
    day = F.xxhash64("d", "n_cells", "n_mag", "mags").cast("decimal(38,0)")
    found = store.read("mag_calendar").where(_is_one_of(series)).groupBy(*SERIES_KEYS).agg(F.count("*").alias("n"), F.sum(day).alias("digest"))
    rows = {(x.measure, x.pct): [str(x.n), str(x.digest)] for x in found.collect()}
    return {s: rows.get(s, ["0", "0"]) for s in series}


def manifest_name(measure: str, pct: float) -> str:
    return f"detect_{measure}_{percentile_tag(pct)}"


def segment_name(measure: str, pct: float) -> str:
    return f"segment_{measure}_{percentile_tag(pct)}"


#: Parameters that come into play only when days are linked.
LINK_PARAMS = ("min_duration", "grace_days")
SEGMENTS = ("seg_day", "seg_cluster", "seg_run")


def _years(days: DataFrame) -> set[str]:
    """Folders of the series and years of some days; bounded by the calendar."""
    rows = days.select(*SERIES_KEYS, F.year("d").alias("year")).distinct().collect()
    return {f"measure={x.measure}/pct={x.pct}/year={x.year}" for x in rows}


def _put_days(store: Store, name: str, new: DataFrame, days: DataFrame) -> None:
    """Put ``new`` in place of all rows that ``days`` have in a table kept by series and year."""
    parts = _years(days)
    if store.exists(name):
        held = store.read(name, parts.__contains__)
        new = held.join(days, DAY_KEYS, "left_anti").select(*new.columns).unionByName(new)
    store.write(name, cut_lineage(new), parts.__contains__)


def segment_changed(store: Store, series: Sequence[tuple[str, float]], params: DetectParams) -> DataFrame:
    """Segment the days whose exceedances are not what they were when they were segmented; returns them.

    Only the month folders of these days are read. The calendar of segments is written last.
    """
    made = {k: v for k, v in asdict(params).items() if k not in LINK_PARAMS}
    other = [s for s in series if not store.is_current(segment_name(*s), made)]
    for s in other:
        store.drop_manifest(segment_name(*s))
    wanted = store.read("mag_calendar").where(_is_one_of(series)).where(in_season(F.col("d"))).select(*DAY_KEYS, "n_mag", "mags")
    known = store.read("seg_calendar").where(_is_one_of(series) & ~_is_one_of(other)) if store.exists("seg_calendar") else None
    todo = wanted
    if known is not None:
        todo = wanted.join(known.select(*wanted.columns), wanted.columns, "left_anti")
    todo = cut_lineage(todo)
    if known is None or not todo.isEmpty():
        days = cut_lineage(todo.select(*DAY_KEYS))
        months = days.select(*SERIES_KEYS, F.year("d").alias("year"), F.month("d").alias("month")).distinct().collect()
        parts = {f"measure={x.measure}/pct={x.pct}/year={x.year}/month={x.month}" for x in months}
        mag = store.read("mag", parts.__contains__).select(*DAY_KEYS, "r", "c", "mag").join(days, DAY_KEYS, "left_semi")
        seg = segment_days(mag, *store.axes(), store.shape(), params)
        for name, df in zip(SEGMENTS, (seg.days, seg.clusters, seg.runs)):
            _put_days(store, name, df, days)
        noted = todo
        if known is not None:
            noted = todo.unionByName(known.select(*todo.columns).join(todo, DAY_KEYS, "left_anti"))
        store.replace_series("seg_calendar", cut_lineage(noted), series)
    for s in other:
        store.save_manifest(segment_name(*s), made)
    return todo.select(*DAY_KEYS)


def _kept_days(store: Store, series: Sequence[tuple[str, float]], params: DetectParams) -> DataFrame:
    """Heat-wave days that persist, with their positions."""
    calendar = store.read("mag_calendar").where(_is_one_of(series)).where(in_season(F.col("d"))).select(*DAY_KEYS)
    days = store.read("seg_day").where(_is_one_of(series)).drop("year")
    flagged = calendar.join(days, DAY_KEYS, "left").withColumn("is_hw", F.col("area_km2").isNotNull())
    return cut_lineage(number_days(persistent_days(flagged, params.min_duration, params.grace_days)))


def _first_changed(kept: DataFrame, before: DataFrame, changed: DataFrame) -> DataFrame:
    """Per series the first position that must be tracked anew: of a day that is new in the list,
    stands elsewhere in it, or was segmented anew; behind the list where there is none."""
    old = before.select(*DAY_KEYS, F.col("pos").alias("was"))
    marked = kept.select(*DAY_KEYS, "pos").join(old, DAY_KEYS, "left").join(changed.withColumn("anew", F.lit(True)), DAY_KEYS, "left")
    touched = F.col("was").isNull() | (F.col("was") != F.col("pos")) | F.col("anew")
    return marked.groupBy(*SERIES_KEYS).agg(F.coalesce(F.min(F.when(touched, F.col("pos"))), F.max("pos") + 1).alias("first"))


def detect(
    store: Store, params: DetectParams, pcts: Sequence[float] = (80, 90, 95), measures: Sequence[str] = ("t", "hi")
) -> bool:
    """Run the detector for the series whose stored result comes from other rows or parameters.

    Whether there is anything to do is told from the digests of the days. Days are segmented
    once, and again when their exceedances change; clusters are linked again from the first day
    on that is new, moved or changed, on to the stored events of the days before. A result
    replaces everything its series had, also when nothing is left of it.
    """
    series = [(m, check_percentile(p)) for m in measures for p in pcts]
    with temporary_steps(store.spark):
        content = _content(store, series)
        made_with = {s: {**asdict(params), "rows": content[s]} for s in series}
        stale = [s for s in series if not store.is_current(manifest_name(*s), made_with[s])]
        if not stale:
            return False
        # a result without its manifest comes from a run that did not end
        trusted = [s for s in stale if store.load_manifest(manifest_name(*s)) is not None]
        for s in stale:
            store.drop_manifest(manifest_name(*s))
        changed = segment_changed(store, stale, params)
        _relink(store, stale, trusted, changed, params)
        for measure, pct in stale:
            mine = (F.col("measure") == measure) & (F.col("pct") == pct)
            clusters = store.read("cluster_event").where(mine).select("pos", "cluster_idx", "event_id", "event_id_resolved", "d")
            folder = store.path(f"csv/{measure}_{percentile_tag(pct)}")
            write_csv(clusters, f"{folder}/clusters", ["pos", "cluster_idx"])
            write_csv(store.read("event_summary").where(mine).drop(*SERIES_KEYS), f"{folder}/events", ["event_id"])
            store.save_manifest(manifest_name(measure, pct), made_with[measure, pct])
    return True


def _relink(
    store: Store, stale: Sequence[tuple[str, float]], trusted: Sequence[tuple[str, float]], changed: DataFrame, params: DetectParams
) -> None:
    """Products of the series from their segments; what stands before the first changed day is kept."""
    kept = _kept_days(store, stale, params)
    segments = {name: store.read(name).where(_is_one_of(stale)).drop("year") for name in SEGMENTS}
    changed = cut_lineage(changed)
    days = kept.select(*DAY_KEYS, "pos")
    if trusted:
        old = {n: cut_lineage(store.read(n).where(_is_one_of(trusted))) for n in ("hw_day", "cluster_event", "event_merge")}
        since = cut_lineage(_first_changed(kept, old["hw_day"], changed))
        tracking = track(days, segments["seg_cluster"], segments["seg_run"], since, old["cluster_event"], old["event_merge"])
        before = lambda df, *c: df.join(since, SERIES_KEYS).where(F.col("pos") < F.col("first")).select(*c)
        linked = before(old["cluster_event"], *tracking.linked.columns).unionByName(tracking.linked)
        linked = resolve_events(linked, tracking.history)
        dynamics = before(old["hw_day"], *[F.col(c).cast(t) for c, t in tracking.dynamics.drop("d").dtypes]).unionByName(tracking.dynamics.drop("d"))
    else:
        tracking = track(days, segments["seg_cluster"], segments["seg_run"])
        linked, dynamics, old = tracking.linked, tracking.dynamics.drop("d"), None
    linked = cut_lineage(linked)
    hw_day = kept.select(*DAY_KEYS, "pos", "event", "hsci", "area_km2", "prop_hw").join(dynamics, [*SERIES_KEYS, "pos"])
    hw_day = cut_lineage(hw_day.withColumns({c: F.col(c).cast("float") for c in HW_DAY_FLOATS}))

    # the field inside the hulls of days that are new in the list or were segmented anew; other days keep theirs
    anew = days.select(*DAY_KEYS)
    gone = None
    if old is not None:
        were = old["hw_day"].select(*DAY_KEYS)
        gone = were.join(anew, DAY_KEYS, "left_anti")
        anew = anew.join(were.join(changed, DAY_KEYS, "left_anti"), DAY_KEYS, "left_anti")
    anew = cut_lineage(anew)
    affected = cut_lineage(anew if gone is None else anew.unionByName(gone))
    months = anew.select(*SERIES_KEYS, F.year("d").alias("year"), F.month("d").alias("month")).distinct().collect()
    parts = {f"measure={x.measure}/pct={x.pct}/year={x.year}/month={x.month}" for x in months}
    mag = store.read("mag", parts.__contains__).select(*DAY_KEYS, "r", "c", "mag").join(anew, DAY_KEYS, "left_semi")
    runs = union_runs(segments["seg_run"].join(anew, DAY_KEYS, "left_semi"), DAY_KEYS)
    # the raw field inside the hulls, not the pruned one
    inside = restrict_to_runs(mag, runs, DAY_KEYS)
    if old is None:
        store.replace_series("excd", inside, stale)
    else:
        untrusted = [s for s in stale if s not in trusted]
        if untrusted:
            store.write("excd", store.spark.createDataFrame([], store.read("excd").schema), of_series(untrusted))
        _put_days(store, "excd", inside, affected)
    store.replace_series("hw_day", hw_day, stale)
    store.replace_series("cluster_event", linked, stale)
    store.replace_series("event_merge", tracking.history, stale)
    store.replace_series("event_summary", event_summary(linked), stale)
