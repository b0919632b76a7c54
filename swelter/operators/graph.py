"""Connected components of edge tables, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.session import cut_lineage


def _is_star_forest(edges: DataFrame, keys: list[str]) -> bool:
    """True when every node either points at exactly one centre or is a centre."""
    ends = edges.select(*keys, F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("inn")).unionByName(
        edges.select(*keys, F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("inn"))
    )
    degree = ends.groupBy(*keys, "x").agg(F.sum("out").alias("out"), F.max("inn").alias("inn"))
    return degree.where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("inn") == 1))).isEmpty()


def connected_components(edges: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of an undirected graph with the smallest node it is connected to.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until the edges
    form stars, which takes a logarithmic number of rounds in practice. Every step is a
    map-side combined ``min`` per node plus one join, so no component is ever gathered in
    one place. ``keys`` keep separate graphs (for example days) apart.

    Returns ``(*keys, node, comp)`` for nodes that have an edge; the rest are their own
    component.
    """
    e = edges.select(*keys, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    while not _is_star_forest(e, keys):
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        low = low.withColumn("m", F.least("m", "u"))
        large = (
            both.where("v > u")
            .join(low, [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
        )
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").unionByName(low.select(*keys, "u", F.col("m").alias("v"))).distinct()
        e = cut_lineage(small)
    leaves = e.select(*keys, F.col("u").alias("node"), F.col("v").alias("comp"))
    centres = e.select(*keys, F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return leaves.unionByName(centres)


def attach_components(nodes: DataFrame, labels: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Add ``comp`` to a node table; nodes without an edge keep their own id."""
    mapped = labels.select(*keys, F.col("node").alias(node), F.col("comp").alias("_comp"))
    return (
        nodes.join(mapped, [*keys, node], "left")
        .withColumn("comp", F.coalesce("_comp", F.col(node)))
        .drop("_comp")
    )
