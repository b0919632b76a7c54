"""Summarise: accumulated index per period as CSV and, where matplotlib is there, as a picture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.operators.summary import accumulate_hsci
from swelter.params import MEASURES, percentile_tag
from swelter.sources.store import Store
from swelter.sources.tables import write_csv


def summarise(
    store: Store, measure: str = "t", pct: float = 90, group_by: str = "year", png: str | None = None,
    title: str = "Annual Accumulated HSCI",
) -> DataFrame:
    series = store.read("hw_day").where((F.col("measure") == measure) & (F.col("pct") == float(pct)))
    out = accumulate_hsci(series, group_by).drop("measure", "pct")
    if out.isEmpty():
        raise ValueError("no finite index values for this measure and percentile")
    order = [c for c in ("year", "month_number", "month") if c in out.columns][:1]
    write_csv(out, store.path(f"csv/ahsci_{measure}_{percentile_tag(pct)}_{group_by}"), order)
    if png:
        draw(out.orderBy(*order).collect(), png, title, group_by, MEASURES[measure].index_name)
    return out.orderBy(*order)


def draw(rows: list, png: str, title: str, group_by: str, index: str) -> None:
    """Line per year or month, bars per calendar month. One row per period of the calendar."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    x = [r["year"] if group_by == "year" else r["month"] for r in rows]
    y = [r["ahsci"] for r in rows]
    fig, ax = plt.subplots(figsize=(12, 5.5))
    if group_by == "month-of-year":
        ax.bar(x, y)
    else:
        ax.plot(x, y, marker="o")
    ax.set(title=title, ylabel=f"Accumulated {index} (A{index})", xlabel="Year" if group_by == "year" else "Month")
    fig.savefig(png)
    plt.close(fig)
