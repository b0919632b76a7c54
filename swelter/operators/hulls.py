"""Convex hulls as row runs ``(r, c0, c1)``: a convex raster shape is one run per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swelter.params import DAY_KEYS
from swelter.session import ship_package

CLUSTER_KEYS = [*DAY_KEYS, "cluster"]
RUN_DDL = "measure string, pct double, d date, cluster bigint, r int, c0 int, c1 int"


def row_extremes(pieces: DataFrame) -> DataFrame:
    """First and last column per cluster and grid row, from the pieces' own row ends."""
    ends = pieces.select(*CLUSTER_KEYS, F.inline(F.arrays_zip("edge_r", "edge_c")))
    return ends.groupBy(*CLUSTER_KEYS, F.col("edge_r").alias("r")).agg(
        F.min("edge_c").alias("c0"), F.max("edge_c").alias("c1")
    )


def _left_boundary(y: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Smallest whole column in the hull for every row.

    ``(y, x)`` are points in half-cell units, one per ``y``, ascending; exact in integers.
    """
    hull: list[tuple[int, int]] = []
    for p in zip(y.tolist(), x.tolist()):
        while len(hull) > 1:
            (ay, ax), (by, bx) = hull[-2], hull[-1]
            if (bx - ax) * (p[0] - ay) >= (p[1] - ax) * (by - ay):
                hull.pop()
            else:
                break
        hull.append(p)
    hy = np.array([h[0] for h in hull], dtype=np.int64)
    hx = np.array([h[1] for h in hull], dtype=np.int64)
    seg = np.clip(np.searchsorted(hy, 2 * rows, side="right") - 1, 0, hy.size - 2)
    dy = hy[seg + 1] - hy[seg]
    num = hx[seg] * dy + (hx[seg + 1] - hx[seg]) * (2 * rows - hy[seg])
    return -((-num) // (2 * dy))


def hull_rows(r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells whose centre lies in or on the hull of the cells' edge midpoints."""
    r, c0, c1 = (np.asarray(v, dtype=np.int64) for v in (r, c0, c1))
    rows = np.arange(r.min(), r.max() + 1)

    def boundary(first: np.ndarray) -> np.ndarray:
        y = np.concatenate((2 * r - 1, 2 * r, 2 * r + 1))
        x = np.concatenate((2 * first, 2 * first - 1, 2 * first))
        order = np.lexsort((x, y))
        y, x = y[order], x[order]
        keep = np.concatenate(([True], np.diff(y) != 0))
        return _left_boundary(y[keep], x[keep], rows)

    return rows, boundary(c0), -boundary(-c1)


def convex_hull_runs(extremes: DataFrame) -> DataFrame:
    """Hull of every cluster as runs. A task gets at most one row per grid row of a cluster."""

    ship_package(extremes.sparkSession)

    def one(key, table):
        rows, left, right = hull_rows(*(table.column(n).to_numpy() for n in ("r", "c0", "c1")))
        head = {
            name: pa.array([k.as_py()] * rows.size, typ)
            for name, k, typ in zip(CLUSTER_KEYS, key, (pa.string(), pa.float64(), pa.date32(), pa.int64()))
        }
        runs = {n: pa.array(v.astype(np.int32)) for n, v in (("r", rows), ("c0", left), ("c1", right))}
        return pa.table({**head, **runs})

    return extremes.groupBy(*CLUSTER_KEYS).applyInArrow(one, RUN_DDL)


def run_length():
    return (F.col("c1") - F.col("c0") + 1).cast("bigint")


def hull_centroid(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean 1-based row and column over the cells of the runs, and their number."""
    n = run_length()
    return runs.groupBy(*keys).agg(
        F.sum(n).alias("n_hull"),
        (F.sum(F.col("r") * n) / F.sum(n) + 1.0).alias("row_pos"),
        (F.sum((F.col("c0") + F.col("c1")) * n) / (2.0 * F.sum(n)) + 1.0).alias("col_pos"),
    )


def union_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Merge overlapping or touching runs of a row; the result covers every cell once."""
    row = Window.partitionBy(*keys, "r").orderBy("c0", "c1")
    before = F.max("c1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.withColumn("_new", F.coalesce((F.col("c0") > before + 1).cast("int"), F.lit(1)))
    island = starts.withColumn("_run", F.sum("_new").over(row))
    return island.groupBy(*keys, "r", "_run").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_run")


def restrict_to_runs(cells: DataFrame, runs: DataFrame, keys: list[str], block: int = 256) -> DataFrame:
    """Cells that lie in one of the (disjoint) runs of their row.

    Runs are also cut at multiples of ``block`` columns, so the equi-join key narrows the
    candidates to the runs that reach into the cell's block.
    """
    cut = runs.select(*keys, "r", "c0", "c1", _blocks(block).alias("_blk"))
    return (
        cells.withColumn("_blk", F.floor(F.col("c") / block))
        .join(cut, [*keys, "r", "_blk"])
        .where("c between c0 and c1")
        .drop("_blk", "c0", "c1")
    )


def _blocks(block: int):
    return F.explode(F.sequence(F.floor(F.col("c0") / block), F.floor(F.col("c1") / block)))
