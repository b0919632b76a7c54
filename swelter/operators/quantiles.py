"""Exact linear (type 7) quantiles of positive values, and what the exposure tables derive from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swelter.functions.numeric import as_flag
from swelter.session import cut_lineage

ACCURACY = 20_000
#: Parts that the values of a group are cut into before ranking.
BUCKETS = 200
EXTREME_PROB = 0.90
TERCILES = (1.0 / 3.0, 2.0 / 3.0)


def positive_quantiles(
    df: DataFrame, by: list[str], columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """``(*by, name, p, n, q)`` for the positive values of every column.

    A sketch cuts the values of a group into about ``BUCKETS`` parts. Values are counted per
    part, so the part that holds a rank is known exactly however good the sketch was, and
    only the distinct values of that part are ordered. The way is the same for every size;
    no task orders more than one part. Groups without a positive value are absent.
    """
    long = df.select(
        *by, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    ).where("v > 0 and v < double('Infinity')")
    keys = [*by, "name"]
    tally = cut_lineage(long.groupBy(*keys, "v").agg(F.count("*").alias("m")))
    cuts = [k / BUCKETS for k in range(1, BUCKETS)]
    bounds = tally.groupBy(*keys).agg(
        F.sum("m").alias("n"), F.percentile_approx("v", cuts, accuracy).alias("_cuts")
    )
    tally = tally.join(bounds, keys).withColumn("part", F.size(F.filter("_cuts", lambda c: c < F.col("v"))))
    parts = tally.groupBy(*keys, "part", "n").agg(F.sum("m").alias("held"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
    last = F.col("n") - 1
    ranks = [
        F.struct(
            F.lit(p).alias("p"), F.lit(side).alias("side"), F.least(F.floor(F.lit(p) * last) + side, last).alias("rank"),
            (F.lit(p) * last - F.floor(F.lit(p) * last)).alias("frac"),
        )
        for p in probs
        for side in (0, 1)
    ]
    want = parts.select("*", F.inline(F.array(*ranks))).where("rank >= start and rank < start + held")
    upto = F.sum("m").over(Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    inside = tally.join(want.select(*keys, "part").distinct(), [*keys, "part"]).select(*keys, "part", "v", "m", upto.alias("upto"))
    found = inside.join(want, [*keys, "part"]).where("rank >= start + upto - m and rank < start + upto")
    value = lambda side: F.max(F.when(F.col("side") == side, F.col("v")))
    ends = found.groupBy(*keys, "p", "n", "frac").agg(value(0).alias("a"), value(1).alias("b"))
    return ends.select(*keys, "p", "n", (F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")).alias("q"))


def with_quantiles(df: DataFrame, by: list[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Attach the quantiles as ``_q_<column>`` maps from probability index to value."""
    table = positive_quantiles(df, by, columns, probs)
    index = F.lit(len(probs))
    for i, p in enumerate(probs):
        index = F.when(F.col("p") == F.lit(p), F.lit(i)).otherwise(index)
    wide = table.groupBy(*by).agg(
        *[
            F.map_from_entries(
                F.collect_list(F.when(F.col("name") == c, F.struct(index.alias("i"), F.col("q"))))
            ).alias(f"_q_{c}")
            for c in columns
        ]
    )
    return df.join(wide, by, "left")


def extreme_flag(value: Column, threshold: Column) -> Column:
    """At or above the 0.90 quantile of the positive values; missing values are not extreme."""
    return as_flag(value >= threshold)


def exposure_category(value: Column, q1: Column, q2: Column) -> Column:
    return (
        F.when(value.isNull(), "missing")
        .when((value <= 0) | q1.isNull(), "none")
        .when(value <= q1, "low")
        .when(value <= q2, "moderate")
        .otherwise("high")
    )


def with_quantile_features(
    df: DataFrame, by: list[str], extreme: dict[str, str], category: dict[str, str]
) -> DataFrame:
    """Add extreme flags (``source column -> new column``) and tercile categories."""
    columns = list(dict.fromkeys([*extreme, *category]))
    probs = [EXTREME_PROB, *TERCILES]
    out = with_quantiles(df, by, columns, probs)
    q = lambda c, i: F.try_element_at(F.col(f"_q_{c}"), F.lit(i))
    out = out.withColumns({new: extreme_flag(F.col(c), q(c, 0)) for c, new in extreme.items()})
    out = out.withColumns({new: exposure_category(F.col(c), q(c, 1), q(c, 2)) for c, new in category.items()})
    return out.drop(*[f"_q_{c}" for c in columns])
