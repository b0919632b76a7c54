"""Persistence of heat-wave days and tracking of clusters from day to day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swelter.operators.graph import connected_components
from swelter.operators.hulls import _blocks
from swelter.operators.linkage import pairwise_km
from swelter.params import SERIES_KEYS
from swelter.session import cut_lineage

LINK_DAYS = 3


def persistent_days(calendar: DataFrame, min_duration: int = 3, grace_days: int = 1) -> DataFrame:
    """Heat-wave days that belong to an event, with all their columns and the ``event`` number.

    ``calendar`` has every season day with a flag ``is_hw``. Within a year two hot days belong
    together when they are neighbours in the list of season days or, with any grace, one day
    apart. A longer gap always ends the event, whatever the grace. Bridging days are neither
    counted nor kept. All windows are over days, so no partition outgrows the calendar.
    """
    by_year = Window.partitionBy(*SERIES_KEYS, "year").orderBy("d")
    hot = (
        calendar.withColumn("year", F.year("d"))
        .withColumn("pos", F.row_number().over(by_year))
        .where("is_hw")
        .withColumn("step", F.col("pos") - F.lag("pos").over(by_year))
    )
    reach = 2 if grace_days >= 1 else 1
    island = F.sum(F.when(F.col("step") <= reach, 0).otherwise(1)).over(by_year)
    runs = hot.withColumn("island", island)
    size = F.count("*").over(Window.partitionBy(*SERIES_KEYS, "year", "island"))
    kept = runs.withColumn("_n", size).where(F.col("_n") >= min_duration)
    order = Window.partitionBy(*SERIES_KEYS).orderBy("year", "island")
    return kept.withColumn("event", F.dense_rank().over(order)).select(*calendar.columns, "event")


def number_days(days: DataFrame) -> DataFrame:
    """Position ``pos`` (0-based) of every kept day in the list of kept days."""
    return days.withColumn("pos", F.row_number().over(Window.partitionBy(*SERIES_KEYS).orderBy("d")) - 1)


def index_runs(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Maximal runs of consecutive integers per group, as ``(start, end)``."""
    w = Window.partitionBy(*keys).orderBy(index)
    tagged = df.select(*keys, index).distinct().withColumn("_grp", F.col(index) - F.row_number().over(w))
    return tagged.groupBy(*keys, "_grp").agg(F.min(index).alias("start"), F.max(index).alias("end")).drop("_grp")


def overlapping_runs(a: DataFrame, b: DataFrame, keys: list[str], block: int = 256) -> DataFrame:
    """Pairs of runs (columns ``c0, c1``) of the same ``keys`` that share an index.

    Both sides are cut at multiples of ``block`` so that candidates meet on an equi-join key.
    """
    left = a.withColumnsRenamed({"c0": "a0", "c1": "a1"}).withColumn(
        "_blk", F.explode(F.sequence(F.floor(F.col("a0") / block), F.floor(F.col("a1") / block)))
    )
    right = b.withColumn("_blk", _blocks(block))
    return left.join(right, [*keys, "_blk"]).where("a0 <= c1 and c0 <= a1").drop("_blk")


def cluster_overlap(runs: DataFrame, lags: int = LINK_DAYS) -> DataFrame:
    """Pairs of clusters that share a cell, at most ``lags`` kept days apart.

    ``runs``: ``measure, pct, pos, cluster_idx, r, c0, c1``.
    """
    earlier = runs.select(
        *SERIES_KEYS, "r", "c0", "c1", F.col("pos").alias("prev_pos"), F.col("cluster_idx").alias("prev_idx"),
        F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + lags)).alias("pos"),
    )
    later = runs.select(*SERIES_KEYS, "pos", "r", "c0", "c1", "cluster_idx")
    hits = overlapping_runs(earlier, later, [*SERIES_KEYS, "pos", "r"])
    return hits.select(*SERIES_KEYS, "prev_pos", "prev_idx", "pos", "cluster_idx").distinct()


def merge_split_counts(overlap: DataFrame) -> DataFrame:
    """Per day: clusters fed by two or more of the day before, and clusters that fell apart."""
    adjacent = overlap.where(F.col("prev_pos") == F.col("pos") - 1)
    merges = (
        adjacent.groupBy(*SERIES_KEYS, "pos", "cluster_idx").count().where("count >= 2")
        .groupBy(*SERIES_KEYS, "pos").agg(F.count("*").alias("n_merges"), F.lit(0).cast("bigint").alias("n_splits"))
    )
    splits = (
        adjacent.groupBy(*SERIES_KEYS, "pos", "prev_idx").count().where("count >= 2")
        .groupBy(*SERIES_KEYS, "pos").agg(F.lit(0).cast("bigint").alias("n_merges"), F.count("*").alias("n_splits"))
    )
    both = merges.unionByName(splits)
    return both.groupBy(*SERIES_KEYS, "pos").agg(F.sum("n_merges").alias("n_merges"), F.sum("n_splits").alias("n_splits"))


def day_dynamics(days: DataFrame, clusters: DataFrame, overlap: DataFrame) -> DataFrame:
    """Cluster count, merges, splits and centroid distances for every kept day.

    ``days``: series keys and ``pos``; ``clusters``: also ``cluster_idx, lat, lon``.
    """
    keys = [*SERIES_KEYS, "pos"]
    counts = clusters.groupBy(*keys).agg(F.count("*").alias("n_clusters"))
    joined = (
        days.join(counts, keys, "left")
        .join(merge_split_counts(overlap), keys, "left")
        .join(pairwise_km(clusters, keys), keys, "left")
        .na.fill(0, ["n_clusters", "n_merges", "n_splits"])
    )
    return with_pair_change(joined)


def with_pair_change(days: DataFrame, order: str = "pos") -> DataFrame:
    """Change of the mean distance against the kept day before; NULL if either is missing."""
    before = F.lag("mean_pair_km").over(Window.partitionBy(*SERIES_KEYS).orderBy(order))
    return days.withColumn("d_mean_pair_km", F.col("mean_pair_km") - before)


# --- event ids ------------------------------------------------------------------------------


def _node(pos: str, idx: str):
    return F.shiftleft(F.col(pos).cast("bigint"), 31) + F.col(idx).cast("bigint")


def _origins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For every cluster one cluster without predecessor that it descends from.

    Each cluster points at its earliest predecessor; pointers are doubled until they end.
    """
    parent = edges.groupBy(*SERIES_KEYS, F.col("b").alias("node")).agg(F.min("a").alias("up"))
    table = nodes.select(*SERIES_KEYS, "node").join(parent, [*SERIES_KEYS, "node"], "left")
    table = cut_lineage(table.withColumn("up", F.coalesce("up", "node")))
    while True:
        hop = table.select(*SERIES_KEYS, F.col("node").alias("up"), F.col("up").alias("up2"))
        table = cut_lineage(table.join(hop, [*SERIES_KEYS, "up"]))
        done = table.where("up <> up2").isEmpty()
        table = table.select(*SERIES_KEYS, "node", F.col("up2").alias("up"))
        if done:
            return table


def _birth_numbers(births: DataFrame) -> DataFrame:
    """Number births 1, 2, ... in order of day and cluster: rank within the day plus the
    total of earlier days, so only the per-day totals are accumulated in one partition."""
    in_day = Window.partitionBy(*SERIES_KEYS, "pos").orderBy("cluster_idx")
    ranked = births.withColumn("_rn", F.row_number().over(in_day))
    before = Window.partitionBy(*SERIES_KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    per_day = births.groupBy(*SERIES_KEYS, "pos").agg(F.count("*").alias("_n"))
    offset = per_day.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return ranked.join(offset, [*SERIES_KEYS, "pos"]).select(
        *SERIES_KEYS, "node", (F.col("_off") + F.col("_rn")).alias("birth")
    )


def _merge_history(meetings: DataFrame) -> DataFrame | None:
    """When and into which older event each event disappears.

    ``meetings``: ``(x, y, t)``, events x > y touch at day t. An event whose first meeting is
    with an older one ends there, because whatever that one has become by then is older too.
    Ended events hand their later meetings on to the survivor; repeat until none are left.
    The youngest event always ends, and usually most do, so there are few rounds.
    Returns ``(gone, into, t)``; ``into`` outlives the round ``gone`` ends in.
    """
    history = None
    e = meetings
    while not e.isEmpty():
        both = e.select(*SERIES_KEYS, F.col("x").alias("me"), F.col("y").alias("other"), "t").unionByName(
            e.select(*SERIES_KEYS, F.col("y").alias("me"), F.col("x").alias("other"), "t")
        )
        first = both.groupBy(*SERIES_KEYS, "me").agg(F.min(F.struct("t", "other")).alias("f"))
        ends = first.where("f.other < me").select(
            *SERIES_KEYS, F.col("me").alias("gone"), F.col("f.other").alias("into"), F.col("f.t").alias("t")
        )
        ends = cut_lineage(ends)
        while True:  # survivors only: skip over events that end in the same round
            nxt = ends.select(*SERIES_KEYS, F.col("gone").alias("into"), F.col("into").alias("_next"))
            hop = cut_lineage(ends.join(nxt, [*SERIES_KEYS, "into"], "left"))
            moved = not hop.where(F.col("_next").isNotNull()).isEmpty()
            ends = hop.select(*SERIES_KEYS, "gone", F.coalesce("_next", "into").alias("into"), "t")
            if not moved:
                break
        history = ends if history is None else history.unionByName(ends)
        for side in ("x", "y"):
            alias = ends.select(*SERIES_KEYS, F.col("gone").alias(side), F.col("into").alias("_to"))
            e = e.join(alias, [*SERIES_KEYS, side], "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        e = e.where("x <> y").select(*SERIES_KEYS, F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"), "t")
        e = cut_lineage(e.groupBy(*SERIES_KEYS, "x", "y").agg(F.min("t").alias("t")))
    return history


HISTORY_DDL = "measure string, pct double, gone bigint, into bigint, t bigint"


def resolve_events(linked: DataFrame, history: DataFrame) -> DataFrame:
    """Add ``event_id_resolved``: the event that ``event_id`` has become in the end."""
    last = connected_components(history, SERIES_KEYS, "gone", "into")
    last = last.select(*SERIES_KEYS, F.col("node").alias("event_id"), F.col("comp").alias("_root"))
    return linked.join(last, [*SERIES_KEYS, "event_id"], "left").withColumn("event_id_resolved", F.coalesce("_root", "event_id")).drop("_root")


def link_events(clusters: DataFrame, overlap: DataFrame) -> DataFrame:
    """Event id of every cluster, see ``link_clusters``; ``event_id_resolved`` also applies
    merges of later days."""
    return resolve_events(*link_clusters(clusters, overlap))


def link_clusters(clusters: DataFrame, overlap: DataFrame, seeds: DataFrame | None = None, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Event id of every cluster, and when and into which older event each event ends (gone, into, t).

    A cluster that touches none of the last kept days starts a new event, otherwise it takes
    the smallest id among the events it touches, which merges them from that day on. Ids
    given on earlier days stay as they were. Put differently: the id is the oldest event
    connected to the cluster through clusters up to its own day, which is what this computes,
    without a day-by-day loop.

    ``clusters``: series keys, ``pos, cluster_idx``; ``overlap`` as from ``cluster_overlap``.
    Tracking can go on from earlier days: ``seeds`` are the clusters of the last kept days before
    (also ``root``: what their event had become by then), ``given`` the number of events there
    (series keys, ``n``). The history is then that of the new days.
    """
    own = clusters.withColumn("node", _node("pos", "cluster_idx"))
    nodes = own
    if seeds is not None:
        seeds = cut_lineage(seeds.withColumn("node", _node("pos", "cluster_idx")))
        nodes = own.select(*SERIES_KEYS, "node", "pos", "cluster_idx").unionByName(seeds.select(*SERIES_KEYS, "node", "pos", "cluster_idx"))
    edges = cut_lineage(
        overlap.select(
            *SERIES_KEYS, _node("prev_pos", "prev_idx").alias("a"), _node("pos", "cluster_idx").alias("b"),
            F.col("pos").alias("t"),
        )
    )
    origin = _origins(nodes, edges)
    births = nodes.join(
        origin.where("up = node").select(*SERIES_KEYS, "node"), [*SERIES_KEYS, "node"], "left_semi"
    )
    if seeds is not None:
        births = births.join(seeds.select(*SERIES_KEYS, "node"), [*SERIES_KEYS, "node"], "left_anti")
    number = _birth_numbers(births)
    if seeds is not None:
        later = number.join(given, SERIES_KEYS, "left").select(*SERIES_KEYS, "node", (F.col("birth") + F.coalesce("n", F.lit(0))).alias("birth"))
        number = later.unionByName(seeds.select(*SERIES_KEYS, "node", F.col("root").alias("birth")))
    born = cut_lineage(
        origin.join(number.withColumnRenamed("node", "up"), [*SERIES_KEYS, "up"]).select(*SERIES_KEYS, "node", "birth")
    )
    side_a = born.select(*SERIES_KEYS, F.col("node").alias("a"), F.col("birth").alias("ba"))
    side_b = born.select(*SERIES_KEYS, F.col("node").alias("b"), F.col("birth").alias("bb"))
    meetings = cut_lineage(
        edges.join(side_a, [*SERIES_KEYS, "a"])
        .join(side_b, [*SERIES_KEYS, "b"])
        .where("ba <> bb")
        .groupBy(*SERIES_KEYS, F.greatest("ba", "bb").alias("x"), F.least("ba", "bb").alias("y"))
        .agg(F.min("t").alias("t"))
    )
    history = _merge_history(meetings)

    now = own.join(born, [*SERIES_KEYS, "node"]).withColumn("event_id", F.col("birth"))
    if history is not None:
        step = history.select(*SERIES_KEYS, F.col("gone").alias("event_id"), "into", F.col("t").alias("_t"))
        while True:
            now = cut_lineage(now.join(step, [*SERIES_KEYS, "event_id"], "left"))
            passed = F.col("_t") <= F.col("pos")
            moved = not now.where(passed).isEmpty()
            now = now.withColumn("event_id", F.when(passed, F.col("into")).otherwise(F.col("event_id"))).drop("into", "_t")
            if not moved:
                break
    ended = meetings.sparkSession.createDataFrame([], HISTORY_DDL) if history is None else cut_lineage(history.select(*SERIES_KEYS, "gone", "into", F.col("t").cast("bigint").alias("t")))
    return now.drop("birth", "node"), ended


def event_summary(linked: DataFrame) -> DataFrame:
    """Cluster-days per event id (``duration_days``) and the calendar days behind them."""
    return linked.groupBy(*SERIES_KEYS, "event_id").agg(
        F.count("*").alias("duration_days"), F.count_distinct("pos").alias("distinct_days")
    )


@dataclass(frozen=True)
class Tracking:
    """``linked``: event id per cluster and day; ``dynamics``: one row per kept day; ``history``:
    which event ends in which older one, and at what position."""

    linked: DataFrame
    dynamics: DataFrame
    history: DataFrame


def track(
    days: DataFrame, clusters: DataFrame, runs: DataFrame, since: DataFrame | None = None, known: DataFrame | None = None, history: DataFrame | None = None
) -> Tracking:
    """Overlap, event ids and day statistics for kept days.

    ``days``: series keys, ``d, pos``; ``clusters``: day keys, ``cluster, cluster_idx, lat, lon``;
    ``runs``: hull runs per cluster.

    With ``since`` (series keys, ``first``: the first position to be tracked anew) only days from
    there on are linked, on to what is ``known`` of the clusters before (series keys, ``pos,
    cluster_idx, event_id``) and their ``history``; the result then has those days alone.
    """
    keys = [*SERIES_KEYS, "d"]
    placed = clusters.join(days.select(*keys, "pos"), keys)
    if since is not None:
        placed = placed.join(since, SERIES_KEYS).where(F.col("pos") >= F.col("first") - LINK_DAYS)
    placed = cut_lineage(placed)
    hull = runs.join(placed.select(*keys, "cluster", "cluster_idx", "pos"), [*keys, "cluster"])
    overlap = cluster_overlap(hull)
    if since is None:
        overlap = cut_lineage(overlap)
        linked, ended = link_clusters(placed.select(*keys, "pos", "cluster_idx"), overlap)
        return Tracking(resolve_events(linked, ended), day_dynamics(days, placed, overlap), ended)

    overlap = cut_lineage(overlap.join(since, SERIES_KEYS).where(F.col("pos") >= F.col("first")).drop("first"))
    before = known.join(since, SERIES_KEYS).where(F.col("pos") < F.col("first"))
    past = cut_lineage(history.join(since, SERIES_KEYS).where(F.col("t") < F.col("first")).drop("first"))
    given = before.groupBy(*SERIES_KEYS).agg(F.max("event_id").alias("n"))
    near = before.where(F.col("pos") >= F.col("first") - LINK_DAYS).select(*SERIES_KEYS, "pos", "cluster_idx", "event_id")
    seeds = resolve_events(near, past).withColumnRenamed("event_id_resolved", "root").drop("event_id")
    own = placed.where(F.col("pos") >= F.col("first"))
    linked, ended = link_clusters(own.select(*keys, "pos", "cluster_idx"), overlap, seeds, given)
    # the change of the first day is against the day before it
    late = days.join(since, SERIES_KEYS)
    dynamics = day_dynamics(late.where(F.col("pos") >= F.col("first") - 1).drop("first"), placed.where(F.col("pos") >= F.col("first") - 1), overlap)
    dynamics = dynamics.join(since, SERIES_KEYS).where(F.col("pos") >= F.col("first")).drop("first")
    whole = cut_lineage(past.unionByName(ended))
    return Tracking(linked, dynamics, whole)
