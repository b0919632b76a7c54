"""Look-back exposure of admissions.

Everything an admission gets depends only on its ZIP and its date, so the features are
computed once per distinct (ZIP, date) and then joined to the records. Look-backs are range
windows over the day line of a ZIP: a partition holds at most one row per calendar day,
however many admissions a ZIP or a date has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swelter.functions.numeric import as_flag
from swelter.params import LONG_WINDOWS, MAX_BACK_DAYS, PRIOR_WINDOWS

LINE = ["pct", "zip"]


def _back(days: int):
    return Window.partitionBy(*LINE).orderBy("day").rangeBetween(-days, -1)


def per_percentile(pcts: Sequence[float]) -> Column:
    """Repeat a row for every percentile."""
    return F.explode(F.array(*[F.lit(float(p)) for p in pcts]))


def zip_timeline(
    admissions: DataFrame,
    pcts: Sequence[float],
    zip_day_t: DataFrame,
    zip_day_hi: DataFrame,
    hw_dates_hi: DataFrame,
) -> DataFrame:
    """One row per (percentile, ZIP, day) with anything on it: exposure, admissions or both.

    ``admissions``: ``zip, admit``; ``zip_day_*``: ``pct, zip, d, v`` (HI also
    ``near``); ``hw_dates_hi``: ``pct, d``. Partitioned by (pct, zip) once, for the merge of the
    three inputs and for all windows that follow.
    """
    near_type = zip_day_hi.schema["near"].dataType
    anchors = (
        admissions.where(F.col("zip").isNotNull() & F.col("admit").isNotNull())
        .select("zip", F.col("admit").alias("d"))
        .distinct()
        .withColumn("pct", per_percentile(pcts))
        .select("pct", "zip", "d", F.lit(None).cast("double").alias("v_t"), F.lit(None).cast("double").alias("v_hi"),
                F.lit(None).cast(near_type).alias("near"), F.lit(True).alias("anchor"))
    )
    t = zip_day_t.select("pct", "zip", "d", F.col("v").alias("v_t"), F.lit(None).cast("double").alias("v_hi"),
                         F.lit(None).cast(near_type).alias("near"), F.lit(False).alias("anchor"))
    hi = zip_day_hi.select("pct", "zip", "d", F.lit(None).cast("double").alias("v_t"), F.col("v").alias("v_hi"),
                           "near", F.lit(False).alias("anchor"))
    merged = (
        anchors.unionByName(t).unionByName(hi)
        .repartition(*LINE)
        .groupBy(*LINE, "d")
        .agg(F.max("v_t").alias("v_t"), F.max("v_hi").alias("v_hi"), F.max("near").alias("near"),
             F.max("anchor").alias("anchor"))
    )
    domain = hw_dates_hi.select("pct", "d").distinct().withColumn("_hw", F.lit(True))
    return (
        merged.join(domain, ["pct", "d"], "left")
        .withColumn("domain", F.coalesce("_hw", F.lit(False)))
        .withColumn("day", F.unix_date("d"))
        .drop("_hw")
    )


def streak_with_grace(backs: Column, grace_days: int = 1) -> Column:
    """Hot days of the streak that ends the day before, scanning backwards.

    ``backs`` are the distinct day offsets (1 = yesterday) of hot days. Before the i-th
    nearest hot day at offset b there are ``b - i`` cold ones, and the grace is one budget for
    the whole scan, so the i-th counts as long as that number does not exceed it.
    """
    cold_before = F.transform(F.array_sort(backs), lambda b, i: b - (i + 1))
    return F.size(F.filter(cold_before, lambda cold: cold <= grace_days)).cast("double")


def timeline_features(timeline: DataFrame) -> DataFrame:
    """All ZIP-dependent look-back features at the (percentile, ZIP, admission date) anchors."""
    hot_t, hot_hi = F.col("v_t") > 0, F.col("v_hi") > 0
    cols: dict[str, Column] = {}
    for k in PRIOR_WINDOWS:
        for tag, v, hot in (("T", "v_t", hot_t), ("HI", "v_hi", hot_hi)):
            cols[f"days_excd_{tag}_{k}d_prior"] = F.count_if(hot).over(_back(k)).cast("double")
            cols[f"max_excd_{tag}_{k}d_prior"] = F.coalesce(F.max(F.when(hot, F.col(v))).over(_back(k)), F.lit(0.0))
    for k in (3, 7):
        for tag, v in (("T", "v_t"), ("HI", "v_hi")):
            cols[f"zcta_EXCD_{tag}_{k}d_prior"] = F.coalesce(F.sum(v).over(_back(k)), F.lit(0.0))
    for k in LONG_WINDOWS:
        cols[f"days_heatwave_HI_{k}d_prior"] = F.count_if(hot_hi & F.col("domain")).over(_back(k)).cast("double")
        cols[f"days_excd_HI_{k}d_prior"] = F.count_if(hot_hi).over(_back(k)).cast("double")
    cols["_hot_days"] = F.collect_list(F.when(hot_hi, F.col("day"))).over(_back(MAX_BACK_DAYS))
    ever = Window.partitionBy(*LINE).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    cols["_near"] = F.last(F.when(F.col("near").isNotNull(), F.struct("near", "day")), ignorenulls=True).over(ever)

    backs = F.transform("_hot_days", lambda x: F.col("day") - x)
    missing_hi = F.col("v_hi").isNull()
    names = [c for c in cols if not c.startswith("_")]
    return (
        timeline.select("pct", "zip", "d", "day", "anchor", "v_t", "v_hi", *[c.alias(n) for n, c in cols.items()])
        .where("anchor")
        .select(
            "pct", "zip", F.col("d").alias("admit"), "v_t", "v_hi",
            F.when(missing_hi, (F.col("day") - F.col("_near.day")).cast("double")).alias("nearest_hw_back_days_HI_admit_nan"),
            F.when(missing_hi, F.col("_near.near.km")).alias("nearest_hw_space_km_HI_admit_nan"),
            F.when(missing_hi, F.col("_near.near.mag").cast("double")).alias("nearest_hw_excd_HI_admit_nan"),
            streak_with_grace(backs).alias("event_duration_HI_admit_anchor"),
            *names,
        )
    )


def hsci_features(hw_day: DataFrame) -> DataFrame:
    """Date-only features: index on the day and sums over the days before.

    Each heat-wave day is passed on to the 30 dates it precedes, so the sums are one
    aggregation over (percentile, date) with map-side combine. ``hw_day``: ``measure, pct, d, hsci``.
    """
    ahead = hw_day.select(
        "measure", "pct", F.col("hsci").cast("double").alias("h"), "d",
        F.posexplode(F.sequence(F.col("d"), F.date_add("d", MAX_BACK_DAYS))).alias("off", "admit"),
    )
    finite = F.col("h").isNotNull() & ~F.isnan("h")
    cols: list[Column] = []
    for tag, m in (("T", "t"), ("HI", "hi")):
        mine = F.col("measure") == m
        here = mine & (F.col("off") == 0)
        cols.append(F.max(F.when(here, F.col("h"))).alias(f"HSCI_{tag}_admit"))
        cols.append(F.max(F.when(here, F.lit(True))).alias(f"_listed_{tag}"))
        for k in PRIOR_WINDOWS:
            within = mine & finite & F.col("off").between(1, k)
            cols.append(F.coalesce(F.sum(F.when(within, F.col("h"))), F.lit(0.0)).alias(f"HSCI_{tag}_{k}d_prior"))
    far = (F.col("measure") == "hi") & finite & F.col("off").between(1, 30)
    cols.append(F.coalesce(F.sum(F.when(far, F.col("h"))), F.lit(0.0)).alias("HSCI_HI_30d_prior"))
    return ahead.groupBy("pct", "admit").agg(*cols)


def attach_exposure(
    patients: DataFrame, pcts: Sequence[float], zones: DataFrame, features: DataFrame, hsci: DataFrame
) -> DataFrame:
    """Left-join the per-(ZIP, date) and per-date features to the records, one copy per percentile.

    ``patients`` needs ``zip`` and ``admit`` (date or NULL); ``zones`` lists the ZIPs that have a
    cell window. Rules for what is missing: no admission date leaves everything NULL; no window
    leaves ZIP features NULL but keeps the index sums; a T value on a day outside the
    heat-wave list is 0, on a listed day without a hot cell in the window it is NULL.
    """
    located = zones.select("zip").distinct().withColumn("_zone", F.lit(True))
    out = (
        patients.withColumn("pct", per_percentile(pcts))
        .join(located, "zip", "left")
        .join(features, ["pct", "zip", "admit"], "left")
        .join(hsci, ["pct", "admit"], "left")
    )
    dated, zoned = F.col("admit").isNotNull(), F.col("_zone").isNotNull()
    sums = [c for c in hsci.columns if c.endswith("_prior")]
    t_admit = F.coalesce(F.col("v_t"), F.when(F.col("_listed_T").isNull(), F.lit(0.0)))
    zip_cols = [c for c in features.columns if c not in ("pct", "zip", "admit", "v_t", "v_hi")]
    out = out.withColumns(
        {
            **{c: F.when(dated, F.coalesce(c, F.lit(0.0))) for c in sums},
            **{c: F.when(zoned, F.col(c)) for c in zip_cols},
            "zcta_EXCD_T_admit": F.when(dated & zoned, t_admit),
            "zcta_EXCD_HI_admit": F.when(dated & zoned, F.col("v_hi")),
        }
    )
    return out.drop("_zone", "v_t", "v_hi", "_listed_T", "_listed_HI")


def missing_flags(df: DataFrame) -> DataFrame:
    """1.0 where the admission-day value is missing; NULL without an admission date."""
    dated = F.col("admit").isNotNull()
    return df.withColumns(
        {
            f"miss_excd_{tag}_admit": F.when(dated, F.col(f"zcta_EXCD_{tag}_admit").isNull().cast("double"))
            for tag in ("T", "HI")
        }
    )


def any_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            f"any_{name}_{tag}_admit": as_flag(F.col(f"{src}_{tag}_admit") > 0)
            for name, src in (("heat", "HSCI"), ("excd", "zcta_EXCD"))
            for tag in ("T", "HI")
        }
    )


def intensity_features(df: DataFrame) -> DataFrame:
    """Recent and weekly intensity, their difference, and the admission day against both."""
    cols: dict[str, Column] = {}
    for tag in ("T", "HI"):
        recent = F.col(f"zcta_EXCD_{tag}_3d_prior") / F.lit(3.0)
        week = F.col(f"zcta_EXCD_{tag}_7d_prior") / F.lit(7.0)
        admit = F.col(f"zcta_EXCD_{tag}_admit")
        cols[f"excd_{tag}_recent_intensity"] = recent
        cols[f"excd_{tag}_week_intensity"] = week
        cols[f"excd_{tag}_acceleration"] = recent - week
        cols[f"excd_{tag}_admit_vs_3d"] = admit - recent
        cols[f"excd_{tag}_admit_vs_7d"] = admit - week
    return df.withColumns(cols)
