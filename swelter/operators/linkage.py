"""Distances between points of one day: single-linkage clusters and pair statistics."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.functions.numeric import EARTH_RADIUS_KM, haversine_km
from swelter.operators.graph import connected_components
from swelter.params import DAY_KEYS
from swelter.session import cut_lineage

BLOCK = 16  # points are grid cells: a 16 x 16 block holds at most 256 different ones
PAIR_BLOCK = 128


def _box_gap2(near: bool) -> Column:
    """Squared smallest (or largest) distance between the boxes of sides ``p`` and ``q``."""
    total = F.lit(0.0)
    for ax in "xyz":
        lo_p, hi_p, lo_q, hi_q = (F.col(f"{side}.{end}_{ax}") for side in "pq" for end in ("lo", "hi"))
        if near:
            gap = F.greatest(F.lit(0.0), lo_q - hi_p, lo_p - hi_q)
        else:
            gap = F.greatest(F.abs(hi_q - lo_p), F.abs(hi_p - lo_q))
        total = total + gap * gap
    return total


def _boxes(points: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    ends = [f(ax).alias(f"{name}_{ax}") for ax in "xyz" for f, name in ((F.min, "lo"), (F.max, "hi"))]
    return points.groupBy(*keys).agg(*ends, *extra)


def single_linkage(points: DataFrame, cutoff_km: float) -> DataFrame:
    """Clusters of points chained by steps of at most ``cutoff_km``.

    ``points``: day keys, ``comp`` (id), ``pr``/``pc`` (grid cell of the point), ``lat``, ``lon``.
    Adds ``cluster``, the smallest member id.

    The points are put into cubes so small that any two points of a cube are within the
    cutoff: a cube is linked as a star. For two nearby cubes only one question is left, is
    there any pair within the cutoff. The boxes around their points answer it most of the
    time, otherwise blocks of at most 256 cells are compared until a pair is found. No list
    of point pairs is ever produced.
    """
    chord = 2.0 * math.sin(min(max(cutoff_km, 0.0) / (2.0 * EARTH_RADIUS_KM), math.pi / 2.0))
    side = max(chord / math.sqrt(3.0) * (1.0 - 1e-9), 1e-9)
    lat, lon = F.radians("lat"), F.radians("lon")
    placed = points.select(*DAY_KEYS, "comp", "pr", "pc", "lat", "lon").withColumns(
        {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    )
    cube = ["cx", "cy", "cz"]
    # one row per component, read by every step below: stored once
    placed = cut_lineage(placed.withColumns({c: F.floor(F.col(ax) / F.lit(side)) for c, ax in zip(cube, "xyz")}))
    cubes = _boxes(placed, [*DAY_KEYS, *cube], F.min("comp").alias("rep"))
    star = placed.join(cubes.select(*DAY_KEYS, *cube, "rep"), [*DAY_KEYS, *cube]).select(
        *DAY_KEYS, F.col("comp").alias("a"), F.col("rep").alias("b")
    )

    steps = [s for s in product(range(-2, 3), repeat=3) if s > (0, 0, 0)]
    shift = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("i", "j", "k"))]) for s in steps]))
    moved = cubes.withColumn("_s", shift).withColumns(
        {c: F.col(c) + F.col(f"_s.{n}") for c, n in zip(cube, ("i", "j", "k"))}
    )
    near = cut_lineage(
        moved.alias("p")
        .join(cubes.alias("q"), [*DAY_KEYS, *cube])
        .withColumns({"gap": _box_gap2(True), "reach": _box_gap2(False)})
        .where(F.col("gap") <= F.lit(chord * chord * (1 + 1e-9) + 1e-15))
        .select(*DAY_KEYS, F.col("p.rep").alias("a"), F.col("q.rep").alias("b"), "reach")
    )
    sure = F.col("reach") <= F.lit(chord * chord * (1 - 1e-9))
    by_box = near.where(sure).select(*DAY_KEYS, "a", "b")

    blocks = _boxes(
        placed.join(cubes.select(*DAY_KEYS, *cube, "rep"), [*DAY_KEYS, *cube]).withColumns(
            {"br": F.floor(F.col("pr") / BLOCK), "bc": F.floor(F.col("pc") / BLOCK)}
        ),
        [*DAY_KEYS, "rep", "br", "bc"],
        F.collect_set(F.struct("lat", "lon")).alias("pts"),
    )
    body = F.struct("pts", *[f"{end}_{ax}" for ax in "xyz" for end in ("lo", "hi")])
    left = blocks.select(*DAY_KEYS, F.col("rep").alias("a"), body.alias("p"))
    right = blocks.select(*DAY_KEYS, F.col("rep").alias("b"), body.alias("q"))
    close = F.exists(
        "p.pts",
        lambda u: F.exists(
            F.col("q.pts"),
            lambda v: haversine_km(u["lat"], u["lon"], v["lat"], v["lon"]) <= F.lit(float(cutoff_km)),
        ),
    )
    by_cell = (
        near.where(~sure)
        .select(*DAY_KEYS, "a", "b")
        .join(left, [*DAY_KEYS, "a"])
        .join(right, [*DAY_KEYS, "b"])
        .where(_box_gap2(True) <= F.lit(chord * chord * (1 + 1e-9) + 1e-15))
        .where(close)
        .select(*DAY_KEYS, "a", "b")
    )
    labels = connected_components(star.unionByName(by_box).unionByName(by_cell), DAY_KEYS)
    member = labels.select(*DAY_KEYS, F.col("node").alias("comp"), F.col("comp").alias("_c"))
    return points.join(member, [*DAY_KEYS, "comp"], "left").withColumn("cluster", F.coalesce("_c", "comp")).drop("_c")


def pairwise_km(points: DataFrame, keys: list[str], order: str = "cluster_idx") -> DataFrame:
    """Smallest and mean distance over all pairs of points of a day; NULL below two points.

    The mean of all pairs needs all pairs, but not as rows: points go into blocks by their
    number, every task takes two blocks and returns a sum, a minimum and a count.
    """
    blocks = (
        points.withColumn("_blk", F.floor(F.col(order) / PAIR_BLOCK))
        .groupBy(*keys, "_blk")
        .agg(F.collect_list(F.struct(F.col(order).alias("i"), "lat", "lon")).alias("pts"))
    )
    a = blocks.select(*keys, F.col("_blk").alias("ba"), F.col("pts").alias("pa"))
    b = blocks.select(*keys, F.col("_blk").alias("bb"), F.col("pts").alias("pb"))
    km = F.flatten(
        F.transform(
            "pa",
            lambda u: F.transform(
                F.filter(F.col("pb"), lambda v: v["i"] > u["i"]),
                lambda v: haversine_km(u["lat"], u["lon"], v["lat"], v["lon"]),
            ),
        )
    )
    parts = a.join(b, keys).where("ba <= bb").select(*keys, km.alias("km"))
    part = parts.select(
        *keys,
        F.array_min("km").alias("lo"),
        F.aggregate("km", F.lit(0.0), lambda s, x: s + x).alias("s"),
        F.size("km").alias("n"),
    )
    total = part.groupBy(*keys).agg(F.min("lo").alias("min_pair_km"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return total.select(*keys, "min_pair_km", F.try_divide("s", "n").alias("mean_pair_km"))
