"""Grid axes: construction, lookup, interpolation and comparison.

An axis is a table ``(idx INT, coord DOUBLE)`` of cell centres, 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def affine_axis(spark: SparkSession, n: int, origin: float, step: float) -> DataFrame:
    """Centres of ``n`` cells whose first outer edge is at ``origin``; stored in single precision."""
    centre = F.lit(origin) + (F.col("id") + F.lit(0.5)) * F.lit(step)
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), centre.cast("float").cast("double").alias("coord"))


def flat_index(r: Column, c: Column, ny: int | Column) -> Column:
    """Column-major position of a cell."""
    return c.cast("bigint") * ny + r


def axis_at_cell(df: DataFrame, axis: DataFrame, index: str, out: str) -> DataFrame:
    """Add the coordinate of cell ``index``."""
    side = axis.select(F.col("idx").alias(index), F.col("coord").alias(out))
    return df.join(side, index, "left")


def interp_axis(df: DataFrame, axis: DataFrame, position: str, out: str) -> DataFrame:
    """Coordinate at a fractional 1-based ``position``, linear between centres, clamped at the ends."""
    nxt = axis.select((F.col("idx") - 1).alias("idx"), F.col("coord").alias("_b"))
    seg = axis.select("idx", F.col("coord").alias("_a")).join(nxt, "idx", "left")
    last = axis.select((F.max("idx") + 1).cast("double").alias("n")).scalar()
    seg = seg.withColumnRenamed("idx", "_i")
    pos = F.greatest(F.lit(1.0), F.least(F.col(position), last))
    placed = df.withColumn("_pos", pos).withColumn("_i", (F.floor("_pos") - 1).cast("int"))
    frac = F.col("_pos") - F.floor("_pos")
    value = F.col("_a") + F.when(frac > 0, frac * (F.col("_b") - F.col("_a"))).otherwise(F.lit(0.0))
    return placed.join(seg, "_i", "left").withColumn(out, value).drop("_i", "_pos", "_a", "_b")


def nearest_index(points: DataFrame, axis: DataFrame, coord: str, out: str) -> DataFrame:
    """Index of the axis entry closest to ``coord``, the first one on ties; NULL for no coordinate.

    The axis (one entry per grid row or column) is one sorted array, searched by halving in
    every row: the points are not moved.
    """
    entry = F.struct("coord", "idx")
    distinct = axis.where("coord is not null").groupBy("coord").agg(F.min("idx").alias("idx"))
    found = points.withColumn("_axis", distinct.agg(F.sort_array(F.collect_list(entry)).alias("a")).scalar())
    found = found.withColumn("_x", F.col(coord).cast("double"))
    middle = "cast((s.lo + s.hi) div 2 as int)"
    at = F.expr(f"""aggregate(sequence(1, length(bin(size(_axis)))), named_struct('lo', 0, 'hi', size(_axis)),
        (s, _) -> if(s.lo >= s.hi, s, if(get(_axis, {middle}).coord < _x,
            named_struct('lo', {middle} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle}))), s -> s.lo)""")
    found = found.withColumn("_at", at)

    def neighbour(step: int) -> Column:
        e = F.get("_axis", F.col("_at") + step)
        return F.when(e.isNotNull(), F.struct(F.abs(e["coord"] - F.col("_x")).alias("gap"), e["idx"].alias("idx")))

    best = F.when(F.col("_x").isNotNull(), F.least(neighbour(-1), neighbour(0))["idx"])
    return found.withColumn(out, best).drop("_axis", "_x", "_at")


def grid_signature(axis_row: DataFrame, axis_col: DataFrame) -> DataFrame:
    """One row with the size and the end coordinates of both axes."""

    def ends(axis: DataFrame, name: str) -> list[Column]:
        agg = axis.agg(
            F.count("*").alias("n"), F.min_by("coord", "idx").alias("first"), F.max_by("coord", "idx").alias("last")
        )
        return [
            agg.select("n").scalar().alias(f"n{name}"),
            agg.select("first").scalar().alias(f"{name}0"),
            agg.select("last").scalar().alias(f"{name}1"),
        ]

    return axis_row.sparkSession.range(1).select(*ends(axis_row, "lat"), *ends(axis_col, "lon"))


def same_axis(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    """Same length and every coordinate equal within tolerance."""
    other = b.select("idx", F.col("coord").alias("_o"))
    off = a.join(other, "idx", "full").where(
        F.col("coord").isNull()
        | F.col("_o").isNull()
        | (F.abs(F.col("coord") - F.col("_o")) > F.lit(atol) + F.lit(rtol) * F.abs("_o"))
    )
    return off.isEmpty()
