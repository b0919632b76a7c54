"""Queries on ZIP windows, admissions and their look-back exposure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.operators import exposure, quantiles, zips
from swelter.params import LONG_WINDOWS, PRIOR_WINDOWS
from swelter.plans import bindings as b
from swelter.plans import sqltext as q
from swelter.plans.registry import query
from swelter.session import cut_lineage

PCTS = b.PCTS
KEY = ["row_id", "pct"]


@dataclass(frozen=True)
class Inputs:
    mag: DataFrame
    hw: DataFrame
    windows: DataFrame
    cells: DataFrame
    zip_t: DataFrame
    zip_hi: DataFrame


def inputs(spark, sf) -> Inputs:
    """Stage results the look-backs share; like the tables of a real run they are stored once."""
    cells = cut_lineage(b.mag(spark, sf))
    hw = cut_lineage(b.hw_day(spark, sf, cells))
    axes = b.cell_axes(spark, sf)
    windows = cut_lineage(zips.zip_window(b.centroids(spark, sf), *axes, b.cell_shape(spark, sf)))
    in_window = zips.window_cells(windows, *axes)
    t_days = hw.where("measure = 't'").select("pct", "d")
    t = cells.where("measure = 't'").join(t_days, ["pct", "d"], "left_semi")
    hi = cells.where("measure = 'hi'")
    return Inputs(cells, hw, windows, in_window, zips.zip_day(t, in_window), zips.zip_day(hi, in_window, nearest=True))


def exposed(spark, sf) -> DataFrame:
    """Every admission with all exposure columns, once per percentile."""
    x = inputs(spark, sf)
    people = b.patients(spark, sf)
    line = exposure.zip_timeline(people, PCTS, x.zip_t, x.zip_hi, x.hw.where("measure = 'hi'").select("pct", "d"))
    out = exposure.attach_exposure(
        people, PCTS, x.windows, exposure.timeline_features(line), exposure.hsci_features(x.hw)
    )
    return exposure.intensity_features(exposure.any_flags(exposure.missing_flags(out)))


def admission_values(spark, sf) -> DataFrame:
    """Admission-day exposure, stored because the quantiles read it more than once."""
    return cut_lineage(exposed(spark, sf).select(*KEY, *_ADMIT_COLS))


def _round(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query(f"with {q.WINDOWS} select zip, r_near, c_near, r0, r1, c0, c1 from win")
def zip_window(spark, sf):
    w = zips.zip_window(b.centroids(spark, sf), *b.cell_axes(spark, sf), b.cell_shape(spark, sf))
    return w.select("zip", "r_near", "c_near", "r0", "r1", "c0", "c1")


@query(f"""with {q.mag(PCTS)}, {q.WINDOWS} select measure, pct, zip, d, r, c, round(mag::double,4) mag
from mag join win on r between r0 and r1 and c between c0 and c1""")
def spatial_window_scan(spark, sf):
    w = zips.zip_window(b.centroids(spark, sf), *b.cell_axes(spark, sf), b.cell_shape(spark, sf))
    cells = zips.spatial_window(b.mag(spark, sf), w)
    return cells.select("measure", "pct", "zip", "d", "r", "c", F.round(F.col("mag").cast("double"), 4).alias("mag"))


@query(f"""with {q.zip_days(PCTS)} select 'hi' measure, pct, zip, d, round(v,6) v from zhi
union all select 't', pct, zip, d, round(v,6) from zt""")
def zip_day_avg(spark, sf):
    x = inputs(spark, sf)
    both = x.zip_hi.drop("near").withColumn("measure", F.lit("hi")).unionByName(x.zip_t.withColumn("measure", F.lit("t")))
    return both.select("measure", "pct", "zip", "d", F.round("v", 6).alias("v"))


@query(f"""with {q.WINDOWS}, {q.PATIENTS} select row_id, zip, r0, r1, c0, c1 from pat left join win using (zip)""")
def patient_zip_left(spark, sf):
    w = zips.zip_window(b.centroids(spark, sf), *b.cell_axes(spark, sf), b.cell_shape(spark, sf))
    return b.patients(spark, sf).select("row_id", "zip").join(w.select("zip", "r0", "r1", "c0", "c1"), "zip", "left")


@query(f"""with {q.exposure(PCTS)} select row_id, adm.pct, round(t.hsci,6) "HSCI_T_admit", round(h.hsci,6) "HSCI_HI_admit"
from adm left join hw t on t.measure='t' and t.pct=adm.pct and t.d=admit
left join hw h on h.measure='hi' and h.pct=adm.pct and h.d=admit""")
def hsci_admit(spark, sf):
    return exposed(spark, sf).select(*KEY, *_round("HSCI_T_admit", "HSCI_HI_admit"))


_BACK_SQL = f"""{q.exposure(PCTS)},
lb as (select row_id, a.pct, 't' m, date_diff('day', d, admit) off, v, false domain from adm a join zt z
  on z.pct=a.pct and z.zip=a.zip and z.d between admit-30 and admit-1 where zoned
 union all select row_id, a.pct, 'hi', date_diff('day', z.d, admit), v, hw.d is not null from adm a join zhi z
  on z.pct=a.pct and z.zip=a.zip and z.d between admit-30 and admit-1
  left join hw on hw.measure='hi' and hw.pct=z.pct and hw.d=z.d where zoned)"""


def _windows_sql() -> str:
    cols = []
    for k in PRIOR_WINDOWS:
        for tag, m in (("T", "t"), ("HI", "hi")):
            cond = f"m='{m}' and off<={k} and v>0"
            cols.append(
                f"case when zoned then cast(count(*) filter (where {cond}) as double) end \"days_excd_{tag}_{k}d_prior\", "
                f"case when zoned then round(coalesce(max(v) filter (where {cond}),0),6) end \"max_excd_{tag}_{k}d_prior\""
            )
    for k in (3, 7):
        for tag, m in (("T", "t"), ("HI", "hi")):
            cols.append(
                f"case when zoned then round(coalesce(sum(v) filter (where m='{m}' and off<={k}),0),6) end "
                f"\"zcta_EXCD_{tag}_{k}d_prior\""
            )
    return ", ".join(cols)


_PRIOR = [f"{kind}_excd_{tag}_{k}d_prior" for k in PRIOR_WINDOWS for tag in ("T", "HI") for kind in ("days", "max")]
_PRIOR += [f"zcta_EXCD_{tag}_{k}d_prior" for k in (3, 7) for tag in ("T", "HI")]


@query(f"""with {_BACK_SQL} select adm.row_id, adm.pct, {_windows_sql()}
from adm left join lb on lb.row_id=adm.row_id and lb.pct=adm.pct group by adm.row_id, adm.pct, zoned""")
def prior_windows(spark, sf):
    return exposed(spark, sf).select(*KEY, *_round(*_PRIOR))


def _hsci_sql() -> str:
    cols = [
        f"round(coalesce(sum(hsci) filter (where measure='{m}' and date_diff('day',d,admit)<={k}),0),6) \"HSCI_{tag}_{k}d_prior\""
        for tag, m, ks in (("T", "t", PRIOR_WINDOWS), ("HI", "hi", (*PRIOR_WINDOWS, 30)))
        for k in ks
    ]
    return ", ".join(cols)


@query(f"""with {q.exposure(PCTS)} select row_id, adm.pct, {_hsci_sql()}
from adm left join hw on hw.pct=adm.pct and hw.d between admit-30 and admit-1 group by row_id, adm.pct""")
def hsci_30d_prior(spark, sf):
    names = [f"HSCI_{tag}_{k}d_prior" for tag in ("T", "HI") for k in PRIOR_WINDOWS] + ["HSCI_HI_30d_prior"]
    return exposed(spark, sf).select(*KEY, *_round(*names))


def _long_sql(name: str, extra: str) -> str:
    cols = ", ".join(
        f"case when zoned then cast(count(*) filter (where m='hi' and v>0 and off<={k}{extra}) as double) end "
        f"\"{name}_HI_{k}d_prior\""
        for k in LONG_WINDOWS
    )
    return f"""with {_BACK_SQL} select adm.row_id, adm.pct, {cols}
from adm left join lb on lb.row_id=adm.row_id and lb.pct=adm.pct group by adm.row_id, adm.pct, zoned"""


@query(_long_sql("days_heatwave", " and domain"))
def heatwave_days_lookback(spark, sf):
    return exposed(spark, sf).select(*KEY, *[f"days_heatwave_HI_{k}d_prior" for k in LONG_WINDOWS])


@query(_long_sql("days_excd", ""))
def excd_days_lookback(spark, sf):
    return exposed(spark, sf).select(*KEY, *[f"days_excd_HI_{k}d_prior" for k in LONG_WINDOWS])


@query(f"""with {_BACK_SQL},
grid as (select row_id, pct, o.off from adm, (select unnest(range(1,31)) off) o where zoned),
flag as (select g.row_id, g.pct, g.off, lb.off is not null hot from grid g left join lb
 on lb.row_id=g.row_id and lb.pct=g.pct and lb.off=g.off and m='hi' and v>0),
run as (select *, sum(case when hot then 0 else 1 end) over (partition by row_id, pct order by off) miss from flag),
len as (select row_id, pct, cast(count(*) filter (where hot and miss<=1) as double) n from run group by all)
select adm.row_id, adm.pct, n "event_duration_HI_admit_anchor" from adm left join len on len.row_id=adm.row_id and len.pct=adm.pct""")
def anchored_duration(spark, sf):
    return exposed(spark, sf).select(*KEY, "event_duration_HI_admit_anchor")


@query(f"""with {q.exposure(PCTS)}
select row_id, a.pct, case when h.v is null then cast(date_diff('day', z.d, admit) as double) end "nearest_hw_back_days_HI_admit_nan",
case when h.v is null then round(z.near.km,6) end "nearest_hw_space_km_HI_admit_nan",
case when h.v is null then round(z.near.mag::double,4) end "nearest_hw_excd_HI_admit_nan"
from adm a left join zhi h on h.pct=a.pct and h.zip=a.zip and h.d=admit
asof left join zhi z on z.pct=a.pct and z.zip=a.zip and a.admit > z.d""")
def asof_nearest_hot(spark, sf):
    near = [f"nearest_hw_{x}_HI_admit_nan" for x in ("back_days", "space_km", "excd")]
    out = exposed(spark, sf)
    return out.select(*KEY, near[0], F.round(near[1], 6).alias(near[1]), F.round(near[2], 4).alias(near[2]))


_ADMIT_SQL = f"""{q.exposure(PCTS)},
av as (
 select row_id, adm.pct, zoned, case when zoned then coalesce(t.v, case when hw.d is null then 0.0e0 end) end vt,
  case when zoned then h.v end vh, hw.hsci ht, hh.hsci hhi
 from adm left join zt t on t.pct=adm.pct and t.zip=adm.zip and t.d=admit
 left join zhi h on h.pct=adm.pct and h.zip=adm.zip and h.d=admit
 left join hw on hw.measure='t' and hw.pct=adm.pct and hw.d=admit
 left join hw hh on hh.measure='hi' and hh.pct=adm.pct and hh.d=admit)"""


@query(f"""with {_ADMIT_SQL} select row_id, pct, round(vt,6) "zcta_EXCD_T_admit", round(vh,6) "zcta_EXCD_HI_admit",
cast((vt is null)::int as double) "miss_excd_T_admit", cast((vh is null)::int as double) "miss_excd_HI_admit" from av""")
def miss_flags(spark, sf):
    out = exposed(spark, sf)
    return out.select(*KEY, *_round("zcta_EXCD_T_admit", "zcta_EXCD_HI_admit"), "miss_excd_T_admit", "miss_excd_HI_admit")


@query(f"""with {_ADMIT_SQL} select row_id, pct, cast(coalesce((ht>0)::int,0) as double) "any_heat_T_admit",
cast(coalesce((hhi>0)::int,0) as double) "any_heat_HI_admit", cast(coalesce((vt>0)::int,0) as double) "any_excd_T_admit",
cast(coalesce((vh>0)::int,0) as double) "any_excd_HI_admit" from av""")
def any_flags(spark, sf):
    return exposed(spark, sf).select(*KEY, *[f"any_{n}_{t}_admit" for n in ("heat", "excd") for t in ("T", "HI")])


def _intensity_sql() -> str:
    cols = []
    for tag, v in (("T", "vt"), ("HI", "vh")):
        a, w = f"{tag}3/3.0e0", f"{tag}7/7.0e0"
        for name, expr in (
            ("recent_intensity", a), ("week_intensity", w), ("acceleration", f"{a}-{w}"),
            ("admit_vs_3d", f"{v}-{a}"), ("admit_vs_7d", f"{v}-{w}"),
        ):
            cols.append(f"round({expr},6)+0.0 \"excd_{tag}_{name}\"")
    return ", ".join(cols)


@query(f"""with {_BACK_SQL}, {_ADMIT_SQL.split(q.exposure(PCTS) + ',', 1)[1]},
s as (select adm.row_id, adm.pct, case when zoned then coalesce(sum(v) filter (where m='t' and off<=3),0) end T3,
 case when zoned then coalesce(sum(v) filter (where m='t' and off<=7),0) end T7,
 case when zoned then coalesce(sum(v) filter (where m='hi' and off<=3),0) end HI3,
 case when zoned then coalesce(sum(v) filter (where m='hi' and off<=7),0) end HI7
 from adm left join lb on lb.row_id=adm.row_id and lb.pct=adm.pct group by adm.row_id, adm.pct, zoned)
select row_id, pct, {_intensity_sql()} from s join av using (row_id, pct)""")
def intensity_derived(spark, sf):
    parts = ("recent_intensity", "week_intensity", "acceleration", "admit_vs_3d", "admit_vs_7d")
    return exposed(spark, sf).select(*KEY, *_round(*[f"excd_{t}_{p}" for t in ("T", "HI") for p in parts]))


_ADMIT_COLS = ["zcta_EXCD_T_admit", "zcta_EXCD_HI_admit"]


@query(f"""with {_ADMIT_SQL},
x as (select pct, 'zcta_EXCD_T_admit' name, vt v from av where vt>0 union all select pct, 'zcta_EXCD_HI_admit', vh from av where vh>0)
select pct, name, count(*) n, round(quantile_cont(v,0.9),6) q from x group by all""")
def extreme_threshold(spark, sf):
    t = quantiles.positive_quantiles(admission_values(spark, sf), ["pct"], _ADMIT_COLS, [quantiles.EXTREME_PROB])
    return t.select("pct", "name", "n", F.round("q", 6).alias("q"))


@query(f"""with {_ADMIT_SQL}, k as (select pct, quantile_cont(vt,0.9) filter (where vt>0) kt,
 quantile_cont(vh,0.9) filter (where vh>0) kh from av group by pct)
select row_id, pct, cast(coalesce((vt>=kt)::int,0) as double) "extreme_excd_T_admit",
cast(coalesce((vh>=kh)::int,0) as double) "extreme_excd_HI_admit" from av join k using (pct)""")
def extreme_flag(spark, sf):
    names = {c: c.replace("zcta_EXCD", "extreme_excd") for c in _ADMIT_COLS}
    out = quantiles.with_quantile_features(admission_values(spark, sf), ["pct"], names, {})
    return out.select(*KEY, *names.values())


def _cat(v: str, k: str) -> str:
    return f"""case when {v} is null then 'missing' when {v}<=0 then 'none' when {v}<={k}[1] then 'low'
 when {v}<={k}[2] then 'moderate' else 'high' end"""


@query(f"""with {_ADMIT_SQL}, k as (select pct, quantile_cont(vt,[1.0/3,2.0/3]) filter (where vt>0) kt,
 quantile_cont(vh,[1.0/3,2.0/3]) filter (where vh>0) kh from av group by pct)
select row_id, pct, {_cat('vt', 'kt')} "excd_T_admit_cat", {_cat('vh', 'kh')} "excd_HI_admit_cat" from av join k using (pct)""")
def exposure_category(spark, sf):
    names = {"zcta_EXCD_T_admit": "excd_T_admit_cat", "zcta_EXCD_HI_admit": "excd_HI_admit_cat"}
    out = quantiles.with_quantile_features(admission_values(spark, sf), ["pct"], {}, names)
    return out.select(*KEY, *names.values())
