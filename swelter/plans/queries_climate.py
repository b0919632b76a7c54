"""Queries on climatology, daily index, persistence and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from swelter.operators import climatology, events, summary
from swelter.params import DAY_KEYS, SERIES_KEYS
from swelter.plans import bindings as b
from swelter.plans import sqltext as q
from swelter.plans.registry import query


def _r(name: str, digits: int = 6):
    return F.round(F.col(name).cast("double"), digits).alias(name)


@query(f"""with {q.CELL_DAY}, p(pct) as (values (80::double),(90::double),(95::double)),
s as (select r, c, cast(month(d) as integer) mon, list_sort(list(t2)) s, count(t2) n from cell_day group by all)
select r, c, mon as month, pct, n, round({q.hazen('s', 'n', 'pct')},6) q from s, p""")
def prctile_hazen(spark, sf):
    cells = b.cell_day(spark, sf).withColumn("month", F.month("d"))
    out = climatology.hazen_percentiles(cells, ["r", "c", "month"], "t2", b.PCTS)
    return out.select("r", "c", "month", "pct", "n", _r("q"))


@query(f"""with {q.CELL_DAY}, {q.thresholds(b.PCTS)}
select measure, pct, mon as month, r, c, round(thr::double,4) thr from thr""")
def monthly_threshold(spark, sf):
    thr = climatology.monthly_threshold(b.cell_day(spark, sf), b.PCTS)
    return thr.select("measure", "pct", "month", "r", "c", _r("thr", 4))


@query(f"with {q.mag(b.PCTS)} select measure, pct, d, r, c, round(mag::double,4) mag from mag")
def exceedance_mag(spark, sf):
    """Thresholds and exceedances of both measures and all percentiles in one pass."""
    return b.mag(spark, sf, b.PCTS).select(*DAY_KEYS, "r", "c", _r("mag", 4))


@query(f"with {q.mag(b.PCTS)} select measure, pct, d, r, c, round(mag::double,4) mag from mag")
def exceedance_from_thresholds(spark, sf):
    """The same from a threshold table: how days are added later."""
    cells = b.cell_day(spark, sf)
    out = climatology.exceedance_against(cells, climatology.monthly_threshold(cells, b.PCTS))
    return out.select(*DAY_KEYS, "r", "c", _r("mag", 4))


@query(f"""with {q.mag(b.PCTS)} select measure, pct, d, count(*) n_cells, round(avg(mag),6) mean_mag,
round(max(mag)::double,4) max_mag from mag group by all""")
def daily_exceedance(spark, sf):
    """How far above its own climatology the field was on each day."""
    day = b.mag(spark, sf, b.PCTS).groupBy(*DAY_KEYS)
    stats = day.agg(F.count("*").alias("n_cells"), F.avg("mag").alias("mean_mag"), F.max("mag").alias("max_mag"))
    return stats.select(*DAY_KEYS, "n_cells", _r("mean_mag"), _r("max_mag", 4))


@query(f"with {q.hw_days(b.PCTS)} select measure, pct, d, round(hsci,6) hsci from hw")
def hsci_series(spark, sf):
    return summary.hsci_series(b.hw_day(spark, sf)).select(*DAY_KEYS, _r("hsci"))


@query(f"with {q.hw_days(b.PCTS)} select measure, pct, d, cast(event as integer) event from hw")
def hw_events(spark, sf):
    return events.persistent_days(b.domain_days(spark, sf)).select(*DAY_KEYS, "event")


def _ahsci(period: str) -> str:
    return f"""with {q.hw_days(b.PCTS)} select measure, pct, {period}, round(sum(hsci),5) ahsci,
count(*) filter (where hsci>0) heatwave_days from hw group by all"""


@query(_ahsci("cast(year(d) as integer) as year"))
def ahsci_year(spark, sf):
    out = summary.accumulate_hsci(b.hw_day(spark, sf), "year")
    return out.withColumn("ahsci", F.round("ahsci", 5))


@query(_ahsci("cast(date_trunc('month', d) as date) as month"))
def ahsci_month(spark, sf):
    out = summary.accumulate_hsci(b.hw_day(spark, sf), "month")
    return out.withColumn("ahsci", F.round("ahsci", 5))


@query(_ahsci("cast(month(d) as integer) month_number, strftime(d,'%b') as month"))
def ahsci_month_of_year(spark, sf):
    out = summary.accumulate_hsci(b.hw_day(spark, sf), "month-of-year")
    return out.withColumn("ahsci", F.round("ahsci", 5))


@query(f"""with {q.hw_days(b.PCTS)},
i as (select measure, pct, d, row_number() over (partition by measure, pct order by d)
 - date_diff('day', date '1970-01-01', d) k from hw)
select measure, pct, min(d) as "start", max(d) as "end" from i group by measure, pct, k""")
def index_runs(spark, sf):
    """Unbroken calendar stretches of heat-wave days."""
    days = b.hw_day(spark, sf).withColumn("day", F.unix_date("d"))
    runs = events.index_runs(days, SERIES_KEYS, "day")
    return runs.select(*SERIES_KEYS, F.date_from_unix_date("start").alias("start"), F.date_from_unix_date("end").alias("end"))
