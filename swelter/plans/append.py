"""Append: give every admission its heat exposure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.functions.dates import admit_parts, length_of_stay
from swelter.operators import exposure, quantiles, zips
from swelter.operators.grid import same_axis
from swelter.params import LONG_WINDOWS, MAX_BACK_DAYS, PRIOR_WINDOWS, GridShape, check_percentile, percentile_tag
from swelter.plans.detect import manifest_name
from swelter.session import cut_lineage, temporary_steps
from swelter.sources import tables
from swelter.sources.store import Store

TAGS = ("T", "HI")


def output_columns() -> list[str]:
    """The 91 appended columns in file order."""
    both = lambda *patterns: [p.format(t=t) for p in patterns for t in TAGS]
    prior = [
        c
        for k in PRIOR_WINDOWS
        for c in both(f"HSCI_{{t}}_{k}d_prior", f"days_excd_{{t}}_{k}d_prior", f"max_excd_{{t}}_{k}d_prior")
    ]
    longest = list(reversed(LONG_WINDOWS))
    return [
        *both("HSCI_{t}_admit", "zcta_EXCD_{t}_admit", "zcta_EXCD_{t}_3d_prior", "zcta_EXCD_{t}_7d_prior"),
        *both("miss_excd_{t}_admit"),
        *[f"nearest_hw_{x}_HI_admit_nan" for x in ("back_days", "space_km", "excd")],
        *prior,
        "HSCI_HI_30d_prior",
        "event_duration_HI_admit_anchor",
        *[f"days_heatwave_HI_{k}d_prior" for k in longest],
        *[f"days_excd_HI_{k}d_prior" for k in longest],
        "heat_threshold_percentile",
        *admit_parts(F.lit(None)),
        *length_of_stay(F.lit(None), F.lit(None)),
        *both("any_heat_{t}_admit", "any_excd_{t}_admit"),
        *both("excd_{t}_recent_intensity", "excd_{t}_week_intensity", "excd_{t}_acceleration"),
        *both("excd_{t}_admit_vs_3d", "excd_{t}_admit_vs_7d"),
        *both("extreme_excd_{t}_admit"),
        *both("excd_{t}_admit_cat", "excd_{t}_7d_prior_cat"),
    ]


def append_exposure(
    patients: DataFrame,
    centroids: DataFrame,
    hw_day: DataFrame,
    mag_hi: DataFrame,
    excd_t: DataFrame,
    axes: tuple[DataFrame, DataFrame],
    shape: GridShape,
    pcts: Sequence[float],
    buffer: int = 1,
    t_grid: tuple[tuple[DataFrame, DataFrame], GridShape] | None = None,
) -> DataFrame:
    """Input columns plus ``output_columns()``, once per percentile (columns ``row_id, pct``).

    ``patients`` as from ``prepare_patients``. If T lives on another grid pass it as
    ``t_grid``; its windows are then built separately.
    """
    pcts = [check_percentile(p) for p in pcts]
    needed = centroids.join(zips.distinct_zips(patients), "zip", "left_semi")
    windows = cut_lineage(zips.zip_window(needed, *axes, shape, buffer))
    cells = cut_lineage(zips.window_cells(windows, *axes))
    t_cells = cells
    if t_grid is not None and not all(same_axis(a, t) for a, t in zip(axes, t_grid[0])):
        t_windows = zips.zip_window(needed, *t_grid[0], t_grid[1], buffer)
        t_cells = cut_lineage(zips.window_cells(t_windows, *t_grid[0]))

    line = exposure.zip_timeline(
        patients, pcts, zips.zip_day(excd_t, t_cells), zips.zip_day(mag_hi, cells, nearest=True),
        hw_day.where("measure = 'hi'").select("pct", "d"),
    )
    out = exposure.attach_exposure(
        patients, pcts, windows, exposure.timeline_features(line), exposure.hsci_features(hw_day)
    )
    out = exposure.intensity_features(exposure.any_flags(exposure.missing_flags(out)))
    out = out.withColumns(
        {
            "heat_threshold_percentile": F.col("pct"),
            **admit_parts(F.col("admit")),
            **length_of_stay(F.col("admit_ts"), F.col("discharge_ts")),
        }
    )
    admit = {f"zcta_EXCD_{t}_admit": f"excd_{t}_admit_cat" for t in TAGS}
    week = {f"zcta_EXCD_{t}_7d_prior": f"excd_{t}_7d_prior_cat" for t in TAGS}
    extreme = {f"zcta_EXCD_{t}_admit": f"extreme_excd_{t}_admit" for t in TAGS}
    # the quantiles read the values twice, so they are computed from stored rows
    out = quantiles.with_quantile_features(cut_lineage(out), ["pct"], extreme, {**admit, **week})
    given = [c for c in patients.columns if c not in tables.HELPERS]
    clash = {c.lower() for c in given} & {c.lower() for c in output_columns()}
    if clash:
        raise ValueError(f"the admission table already has columns {sorted(clash)}")
    return out.select("row_id", "pct", *given, *output_columns())


def append(
    store: Store, patients_path: str, zip_path: str, pcts: Sequence[float] = (80, 90, 95), buffer: int = 1,
    csv: bool = True,
) -> None:
    """Read admissions and centroids, write ``exposure`` and one CSV folder per percentile."""
    spark = store.spark
    pcts = [check_percentile(p) for p in pcts]
    absent = [f"{m} {percentile_tag(p)}" for p in pcts for m in ("t", "hi") if store.load_manifest(manifest_name(m, p)) is None]
    if absent:
        raise ValueError(f"nothing detected for {absent}; run detect with these percentiles first")
    with temporary_steps(spark):
        patients = cut_lineage(tables.read_patients(spark, patients_path))
        centroids = cut_lineage(tables.read_zip_centroids(spark, zip_path))
        span = patients.agg(F.min("admit"), F.max("admit")).first()
        # only the folders of the wanted percentiles and years; the nearest hot day of hi may lie any time back
        wanted = F.col("pct").isin(*pcts)
        until = F.col("year") <= F.year(F.lit(span[1]))
        since = F.col("year") >= F.year(F.date_sub(F.lit(span[0]), MAX_BACK_DAYS + 1))
        mag = store.read("mag").where(wanted & until & (F.col("measure") == "hi"))
        excd = store.read("excd").where(wanted & since & until & (F.col("measure") == "t"))
        out = append_exposure(
            patients, centroids, store.read("hw_day").where(wanted), mag, excd, store.axes(), store.shape(), pcts, buffer,
        )
        store.write("exposure", out)
    if csv:
        for pct in pcts:
            one = store.read("exposure").where(F.col("pct") == pct).orderBy("row_id").drop("row_id", "pct")
            # names may repeat up to case in a file, so they are restored all at once
            tables.write_csv(one.toDF(*[tables.given_name(c) for c in one.columns]), store.path(f"csv/exposure_{percentile_tag(pct)}"))
