"""From exceedance cells of a day to heat-wave clusters, hulls and the daily index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swelter.functions.numeric import round_half_up
from swelter.operators.grid import axis_at_cell, interp_axis
from swelter.operators.hulls import (
    CLUSTER_KEYS,
    convex_hull_runs,
    hull_centroid,
    row_extremes,
    run_length,
    union_runs,
)
from swelter.operators.linkage import single_linkage
from swelter.operators.tiles import component_table, labelled_pieces
from swelter.params import DAY_KEYS, DetectParams, GridShape
from swelter.session import cut_lineage


@dataclass(frozen=True)
class DaySegments:
    """``days``: index per heat-wave day; ``clusters``: hull centroids; ``runs``: hulls row by row."""

    days: DataFrame
    clusters: DataFrame
    runs: DataFrame


def day_cell_counts(mag: DataFrame, *extra: Column) -> DataFrame:
    return mag.where("mag > 0").groupBy(*DAY_KEYS).agg(F.count("*").alias("n_hot"), *extra)


def keep_days(df: DataFrame, days: DataFrame) -> DataFrame:
    """Semi-join on the day keys; the stored day list is bounded by the calendar."""
    return df.join(cut_lineage(days.select(*DAY_KEYS)), DAY_KEYS, "left_semi")


def day_gate(mag: DataFrame, min_hot_cells: int) -> DataFrame:
    """Days with more than ``min_hot_cells`` exceeding cells."""
    return day_cell_counts(mag).where(F.col("n_hot") > min_hot_cells)


def large_components(components: DataFrame, min_pixels: int) -> DataFrame:
    return components.where(F.col("n_cells") > min_pixels)


def snapped_centroid(components: DataFrame, shape: GridShape) -> DataFrame:
    """Grid cell of a component's centroid: 1-based, rounded half up, clipped, back to 0-based."""

    def snap(position: str, n: int) -> Column:
        one_based = round_half_up(F.col(position) + F.lit(1.0))
        return (F.least(F.greatest(one_based, F.lit(1)), F.lit(n)) - 1).cast("int")

    return components.withColumns({"pr": snap("cen_r", shape.ny), "pc": snap("cen_c", shape.nx)})


def located_components(
    components: DataFrame, axis_row: DataFrame, axis_col: DataFrame, shape: GridShape
) -> DataFrame:
    """Components with ``pr, pc, lat, lon`` of the cell their centroid falls in."""
    placed = snapped_centroid(components, shape)
    return axis_at_cell(axis_at_cell(placed, axis_row, "pr", "lat"), axis_col, "pc", "lon")


def prune_small(mag: DataFrame, shape: GridShape, params: DetectParams) -> DataFrame:
    """Exceeding cells inside large smoothed components, for days that keep enough of them."""
    gated = keep_days(mag, day_gate(mag, params.min_hot_cells))
    pieces = cut_lineage(labelled_pieces(gated, shape, params.tile))
    large = large_components(component_table(pieces), params.min_pixels).select(*DAY_KEYS, "comp")
    kept = pieces.where("n_hot > 0").join(large, [*DAY_KEYS, "comp"], "left_semi")
    enough = kept.groupBy(*DAY_KEYS).agg(F.sum("n_hot").alias("n")).where(F.col("n") > params.min_pixels)
    cells = keep_days(kept, enough).select(*DAY_KEYS, F.inline(F.arrays_zip("hot_r", "hot_c", "hot_mag")))
    return cells.toDF(*DAY_KEYS, "r", "c", "mag")


def daily_index(
    mask: DataFrame, hull: DataFrame, params: DetectParams, keys: list[str] | None = None
) -> DataFrame:
    """Index per day from mask totals ``(n_mask, n_hot, sum_mag)`` and hull size ``n_hull``.

    Days whose hull area does not exceed the gate are no heat-wave days and are left out.
    """
    keys = DAY_KEYS if keys is None else keys
    area = F.col("n_hull") * F.lit(params.pixel_area_km2)
    prop = F.col("n_mask") / F.col("n_hull")
    mean_in = F.try_divide(F.col("sum_mag"), F.col("n_hot"))
    return (
        mask.join(hull, keys)
        .withColumns({"area_km2": area, "prop_hw": prop})
        .where(F.col("area_km2") > params.hull_gate_km2)
        .select(
            *keys,
            (mean_in * (F.col("prop_hw") * F.col("area_km2") / F.lit(params.region_area_km2))).alias("hsci"),
            "area_km2",
            "prop_hw",
        )
    )


def segment_days(
    mag: DataFrame, axis_row: DataFrame, axis_col: DataFrame, shape: GridShape, params: DetectParams
) -> DaySegments:
    """The spatial part of the detector for every day of every measure and percentile at once."""
    pruned = prune_small(mag, shape, params)
    pieces = cut_lineage(labelled_pieces(pruned, shape, params.tile).drop("hot_r", "hot_c", "hot_mag", "shared"))
    points = located_components(component_table(pieces), axis_row, axis_col, shape)
    linked = single_linkage(points, params.cluster_cutoff_km).select(*DAY_KEYS, "comp", "cluster")
    runs = cut_lineage(convex_hull_runs(row_extremes(pieces.join(linked, [*DAY_KEYS, "comp"]))))

    mask = pieces.groupBy(*DAY_KEYS).agg(
        F.sum("n_mask").alias("n_mask"), F.sum("n_hot").alias("n_hot"), F.sum("sum_mag").alias("sum_mag")
    )
    hull = union_runs(runs, DAY_KEYS).groupBy(*DAY_KEYS).agg(F.sum(run_length()).alias("n_hull"))
    days = cut_lineage(daily_index(mask, hull, params))

    centres = hull_centroid(keep_days(runs, days), CLUSTER_KEYS)
    clusters = interp_axis(interp_axis(centres, axis_row, "row_pos", "lat"), axis_col, "col_pos", "lon")
    number = F.row_number().over(Window.partitionBy(*DAY_KEYS).orderBy("cluster"))
    return DaySegments(days, clusters.withColumn("cluster_idx", number), runs)
