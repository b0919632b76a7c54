"""Queries on the daily field: smoothing, components, clusters, hulls, tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swelter.operators import events, hulls, linkage, segments, tiles
from swelter.params import DAY_KEYS, SERIES_KEYS
from swelter.plans import bindings as b
from swelter.plans import sqltext as q
from swelter.plans.registry import query
from swelter.session import cut_lineage

P = b.RASTER_PARAMS
CUTOFF = P.cluster_cutoff_km

# --- SQL: one name per stage ------------------------------------------------------------------

_SMOOTH = f"{q.RASTER},\n{q.smooth('raster', 'mask', 'opened')}"
_COMP = f"{_SMOOTH},\n{q.components('mask', 'lab')}"
_CENT = f"{_COMP},\n{q.centroids('lab', 'cen')}"
_LINK = f"{_CENT},\n{q.linkage('cen', 'lnk', CUTOFF)}"
_CELLS = f"{_LINK},\ncl as (select lab.d, r, c, cluster from lab join lnk using (d, comp))"
# bounding runs: first to last cell of a cluster in every row
_BOX = f"{_CELLS},\nbox as (select d, cluster, r, min(c) c0, max(c) c1 from cl group by all)"
_BOX_CELLS = f"""{_BOX},
bcell as (select d, cluster, r, unnest(generate_series(c0, c1)) c from box)"""


def _labelled(spark, sf) -> DataFrame:
    return tiles.labelled_pieces(b.raster(spark, sf), b.raster_shape(spark, sf), P.tile)


def _components(spark, sf) -> DataFrame:
    return tiles.component_table(_labelled(spark, sf))


def _points(spark, sf) -> DataFrame:
    """Components of the raster with the grid cell and position of their centroids."""
    return segments.located_components(_components(spark, sf), *b.raster_axes(spark, sf), b.raster_shape(spark, sf))


def _clustered(spark, sf) -> DataFrame:
    """Pieces with component and cluster, stored because several steps read them."""
    pieces = cut_lineage(_labelled(spark, sf))
    points = segments.located_components(
        tiles.component_table(pieces), *b.raster_axes(spark, sf), b.raster_shape(spark, sf)
    )
    linked = linkage.single_linkage(points, CUTOFF).select(*DAY_KEYS, "comp", "cluster")
    return pieces.join(linked, [*DAY_KEYS, "comp"])


def _box_runs(spark, sf) -> DataFrame:
    """First to last cell of every cluster in every row, numbered by day for tracking."""
    return cut_lineage(hulls.row_extremes(_clustered(spark, sf)))


def _numbered(runs: DataFrame) -> DataFrame:
    """Add ``pos`` (number of the day) and ``cluster_idx`` (the cluster's own id is its number)."""
    days = events.number_days(runs.select(*DAY_KEYS).distinct())
    return runs.join(days, DAY_KEYS).withColumn("cluster_idx", F.col("cluster").cast("int"))


_NUM = f"""{_BOX},
dn as (select d, row_number() over (order by d)-1 pos from (select distinct d from box)),
nb as (select pos, cluster, r, c0, c1 from box join dn using (d)),
ov as (
 select distinct x.pos prev_pos, x.cluster prev_idx, y.pos pos, y.cluster cluster_idx from nb x join nb y
 on y.r=x.r and y.pos-x.pos between 1 and 3 and x.c0<=y.c1 and y.c0<=x.c1)"""


# --- fields -------------------------------------------------------------------------------------


@query(f"with recursive {_SMOOTH} select d, r, c from opened")
def morph_open(spark, sf):
    return tiles.smooth_mask(b.raster(spark, sf), b.raster_shape(spark, sf), P.tile, "open").select("d", "r", "c")


@query(f"with recursive {_SMOOTH} select d, r, c from mask")
def morph_close(spark, sf):
    return tiles.smooth_mask(b.raster(spark, sf), b.raster_shape(spark, sf), P.tile).select("d", "r", "c")


@query(f"with {q.RASTER} select d, count(*) n_hot, round(max(mag)::double,4) max_mag from raster group by d")
def day_cell_counts(spark, sf):
    counts = segments.day_cell_counts(b.raster(spark, sf), F.max("mag").alias("max_mag"))
    return counts.select("d", "n_hot", F.round(F.col("max_mag").cast("double"), 4).alias("max_mag"))


@query(f"""with {q.RASTER}, m as (select avg(n) n from (select count(*) n from raster group by d))
select d, count(*) n_hot from raster group by d having count(*) > (select cast(floor(n) as bigint) from m)""")
def day_gate(spark, sf):
    """Days with more exceeding cells than the average day."""
    cells = b.raster(spark, sf)
    mean = segments.day_cell_counts(cells).agg(F.floor(F.avg("n_hot"))).first()[0]
    return segments.day_gate(cells, mean).select("d", "n_hot")


@query(f"with recursive {_COMP} select d, r, c, comp from lab")
def connected_components(spark, sf):
    """Component of every cell; pieces from different tiles are joined."""
    field = tiles.label_field(b.raster(spark, sf), b.raster_shape(spark, sf), P.tile)
    return field.select("d", "r", "c", "comp")


@query(f"with recursive {_COMP} select d, comp, count(*) n_cells, round(avg(r),6) cen_r, round(avg(c),6) cen_c from lab group by d, comp")
def component_props(spark, sf):
    c = _components(spark, sf)
    return c.select("d", "comp", "n_cells", F.round("cen_r", 6).alias("cen_r"), F.round("cen_c", 6).alias("cen_c"))


@query(f"""with recursive {_COMP}, big as (select d, comp from lab group by d, comp having count(*) > {P.min_pixels})
select d, r, c, comp, round(mag::double,4) mag from lab join big using (d, comp) join raster using (d, r, c)""")
def component_area_filter(spark, sf):
    """Exceeding cells of components above the minimum size."""
    pieces = cut_lineage(_labelled(spark, sf))
    big = segments.large_components(tiles.component_table(pieces), P.min_pixels).select(*DAY_KEYS, "comp")
    kept = pieces.join(big, [*DAY_KEYS, "comp"], "left_semi")
    cells = kept.select("d", "comp", F.inline(F.arrays_zip("hot_r", "hot_c", "hot_mag"))).toDF("d", "comp", "r", "c", "mag")
    return cells.select("d", "r", "c", "comp", F.round(F.col("mag").cast("double"), 4).alias("mag"))


@query(f"with recursive {_CENT} select d, comp, pr, pc, round(lat,6) lat, round(lon,6) lon from cen")
def component_centroid_ll(spark, sf):
    p = _points(spark, sf)
    return p.select("d", "comp", "pr", "pc", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


# --- clusters and hulls ---------------------------------------------------------------------------


@query(f"with recursive {_LINK} select d, comp, cast(cluster as bigint) cluster from lnk")
def single_linkage(spark, sf):
    return linkage.single_linkage(_points(spark, sf), CUTOFF).select("d", "comp", "cluster")


_PAIR = f"""{_CENT},
pk as (select x.d, {q.haversine('x.lat', 'x.lon', 'y.lat', 'y.lon')} km from cen x join cen y on x.d=y.d and x.comp<y.comp),
pair as (select d, min(km) lo, avg(km) mean from pk group by d)"""


@query(f"with recursive {_PAIR} select d, round(lo,5) min_pair_km, round(mean,5) mean_pair_km from pair")
def pairwise_centroid_km(spark, sf):
    out = linkage.pairwise_km(_points(spark, sf), DAY_KEYS, "comp").where("mean_pair_km is not null")
    return out.select("d", F.round("min_pair_km", 5).alias("min_pair_km"), F.round("mean_pair_km", 5).alias("mean_pair_km"))


@query(f"""with recursive {_PAIR}, al as (select d, mean from (select distinct d from cen) left join pair using (d))
select d, round(mean - lag(mean) over (order by d),5) d_mean_pair_km from al""")
def d_mean_pair_km(spark, sf):
    days = linkage.pairwise_km(_points(spark, sf), DAY_KEYS, "comp")
    return events.with_pair_change(days, "d").select("d", F.round("d_mean_pair_km", 5).alias("d_mean_pair_km"))


_HULL = f"{_CELLS},\n{q.hull('cl', 'hul')}"


@query(f"with recursive {_HULL} select d, cast(cluster as bigint) cluster, r, c0, c1 from hul")
def convex_hull(spark, sf):
    runs = hulls.convex_hull_runs(hulls.row_extremes(_clustered(spark, sf)))
    return runs.select("d", "cluster", "r", "c0", "c1")


@query(f"with recursive {_BOX_CELLS} select distinct d, r, cast(c as integer) c from bcell")
def hull_union(spark, sf):
    """Cells covered by any cluster's runs, each once."""
    runs = hulls.union_runs(_box_runs(spark, sf), DAY_KEYS)
    return runs.select("d", "r", F.explode(F.sequence("c0", "c1")).alias("c"))


@query(f"""with recursive {_BOX_CELLS} select d, r, c, round(mag::double,4) mag from raster
where exists (select 1 from bcell x where x.d=raster.d and x.r=raster.r and x.c=raster.c)""")
def hull_restrict(spark, sf):
    """Raw cells of the field inside the runs of the day."""
    runs = hulls.union_runs(_box_runs(spark, sf), DAY_KEYS)
    inside = hulls.restrict_to_runs(b.raster(spark, sf), runs, DAY_KEYS)
    return inside.select("d", "r", "c", F.round(F.col("mag").cast("double"), 4).alias("mag"))


@query(f"""with recursive {_BOX_CELLS} select d, cast(cluster as bigint) cluster, count(*) n_hull, round(avg(r)+1,6) row_pos,
round(avg(c)+1,6) col_pos from bcell group by d, cluster""")
def hull_centroid(spark, sf):
    out = hulls.hull_centroid(_box_runs(spark, sf), hulls.CLUSTER_KEYS)
    return out.select("d", "cluster", "n_hull", F.round("row_pos", 6).alias("row_pos"), F.round("col_pos", 6).alias("col_pos"))


_AREA = f"{_BOX_CELLS},\nar0 as (select d, count(*) n from (select distinct d, r, c from bcell) group by d)"


@query(f"with recursive {_AREA} select d, n*{P.pixel_area_km2}::double area_km2 from ar0 where n*{P.pixel_area_km2}::double > 300")
def hull_area_gate(spark, sf):
    runs = hulls.union_runs(_box_runs(spark, sf), DAY_KEYS)
    area = runs.groupBy("d").agg((F.sum(hulls.run_length()) * P.pixel_area_km2).alias("area_km2"))
    return area.where("area_km2 > 300")


@query(f"""with recursive {_AREA},
inn as (select lab.d, count(*) n_mask, avg(mag) m from lab left join raster using (d, r, c) group by lab.d)
select d, round(m*(n_mask/n)*n*{P.pixel_area_km2}/{P.region_area_km2},6) hsci, n*{P.pixel_area_km2}::double area_km2,
round(n_mask/n,6) prop_hw from inn join ar0 using (d) where n*{P.pixel_area_km2} > {P.hull_gate_km2}""")
def hsci_index(spark, sf):
    pieces = cut_lineage(_clustered(spark, sf))
    mask = pieces.groupBy(*DAY_KEYS).agg(
        F.sum("n_mask").alias("n_mask"), F.sum("n_hot").alias("n_hot"), F.sum("sum_mag").alias("sum_mag")
    )
    runs = hulls.union_runs(hulls.row_extremes(pieces), DAY_KEYS)
    area = runs.groupBy(*DAY_KEYS).agg(F.sum(hulls.run_length()).alias("n_hull"))
    out = segments.daily_index(mask, area, P)
    return out.select("d", F.round("hsci", 6).alias("hsci"), "area_km2", F.round("prop_hw", 6).alias("prop_hw"))


# --- the whole detector on the raster -------------------------------------------------------------

_PRUNE = f"""{_COMP},
g1 as (select d from raster group by d having count(*) > {P.min_hot_cells}),
big as (select d, comp from lab join g1 using (d) group by d, comp having count(*) > {P.min_pixels}),
pr0 as (select lab.d, r, c, mag from lab join big using (d, comp) join raster using (d, r, c)),
pruned as (select * from pr0 where d in (select d from pr0 group by d having count(*) > {P.min_pixels})),
{q.smooth('pruned', 'mask2')},
{q.components('mask2', 'lab2')},
{q.centroids('lab2', 'cen2')},
{q.linkage('cen2', 'lnk2', CUTOFF)},
cl2 as (select lab2.d, r, c, cluster from lab2 join lnk2 using (d, comp)),
{q.hull('cl2', 'hul2')},
hc as (select d, cluster, r, unnest(generate_series(c0, c1)) c from hul2),
ar2 as (select d, count(*) n from (select distinct d, r, c from hc) group by d),
in2 as (select lab2.d, count(*) n_mask, avg(mag) m from lab2 left join pruned using (d, r, c) group by lab2.d),
day2 as (
 select d, m*(n_mask/n)*n*{P.pixel_area_km2}/{P.region_area_km2} hsci, n*{P.pixel_area_km2}::double area_km2, n_mask/n prop_hw
 from in2 join ar2 using (d) where n*{P.pixel_area_km2} > {P.hull_gate_km2})"""


def _segmented(spark, sf) -> segments.DaySegments:
    return segments.segment_days(b.raster(spark, sf), *b.raster_axes(spark, sf), b.raster_shape(spark, sf), P)


@query(f"with recursive {_PRUNE} select d, round(hsci,6) hsci, area_km2, round(prop_hw,6) prop_hw from day2")
def day_segmentation(spark, sf):
    days = _segmented(spark, sf).days
    return days.select("d", F.round("hsci", 6).alias("hsci"), "area_km2", F.round("prop_hw", 6).alias("prop_hw"))


@query(f"""with recursive {_PRUNE},
hcen as (select d, cluster, avg(r)+1 rp, avg(c)+1 cp from hc where d in (select d from day2) group by all)
select d, cast(cluster as bigint) cluster, cast(row_number() over (partition by d order by cluster) as integer) cluster_idx,
round(25.0e0+(rp-1)*0.05e0,6) lat, round(-100.0e0+(cp-1)*0.05e0,6) lon from hcen""")
def day_clusters(spark, sf):
    c = _segmented(spark, sf).clusters
    return c.select("d", "cluster", "cluster_idx", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


# --- tracking ---------------------------------------------------------------------------------------


@query(f"with recursive {_NUM} select cast(prev_pos as integer) prev_pos, cast(prev_idx as integer) prev_idx, cast(pos as integer) pos, cast(cluster_idx as integer) cluster_idx from ov")
def cluster_overlap(spark, sf):
    return events.cluster_overlap(_numbered(_box_runs(spark, sf))).drop(*SERIES_KEYS)


@query(f"""with recursive {_BOX} select x.d, x.r, cast(x.cluster as bigint) cluster, cast(y.cluster as bigint) other from box x join box y
on x.d=y.d and x.r=y.r and x.cluster<y.cluster and x.c0<=y.c1 and y.c0<=x.c1""")
def runs_overlap(spark, sf):
    """Runs of different clusters that share a cell of the same day and row."""
    runs = _box_runs(spark, sf).select("d", "r", "cluster", "c0", "c1")
    hits = events.overlapping_runs(runs.withColumnRenamed("cluster", "other_"), runs, ["d", "r"])
    return hits.where("other_ < cluster").select("d", "r", F.col("other_").alias("cluster"), F.col("cluster").alias("other")).distinct()


_MS = f"""{_NUM}, adj as (select * from ov where prev_pos=pos-1),
mg as (select pos, count(*) n from (select pos, cluster_idx from adj group by all having count(*)>=2) group by pos),
sp as (select pos, count(*) n from (select pos, prev_idx from adj group by all having count(*)>=2) group by pos)"""


@query(f"with recursive {_MS} select cast(pos as integer) pos, coalesce(mg.n,0) n_merges, coalesce(sp.n,0) n_splits from mg full join sp using (pos)")
def merge_split_counts(spark, sf):
    overlap = cut_lineage(events.cluster_overlap(_numbered(_box_runs(spark, sf))))
    return events.merge_split_counts(overlap).drop(*SERIES_KEYS)


# Ids by definition: the oldest start connected to a cluster through days up to its own.
_LINKED = f"""{_NUM},
nd as (select distinct pos, cluster from nb),
st as (select pos, cluster, row_number() over (order by pos, cluster) num from nd
 where not exists (select 1 from ov where ov.pos=nd.pos and ov.cluster_idx=nd.cluster)),
ed as (select prev_pos p1, prev_idx c1, pos p2, cluster_idx c2 from ov union all select pos, cluster_idx, prev_pos, prev_idx from ov),
rch(p0, c0, p, c) as (
 select pos, cluster, pos, cluster from nd
 union select p0, c0, p2, c2 from rch join ed on p1=p and c1=c where p2<=p0),
lk as (select p0 pos, c0 cluster, min(num) event_id from rch join st on st.pos=rch.p and st.cluster=rch.c group by all)"""


def _event_links(spark, sf) -> DataFrame:
    runs = cut_lineage(_numbered(_box_runs(spark, sf)))
    clusters = runs.select(*SERIES_KEYS, "pos", "cluster_idx").distinct()
    return events.link_events(clusters, events.cluster_overlap(runs))


@query(f"with recursive {_LINKED} select cast(pos as integer) pos, cast(cluster as integer) cluster_idx, event_id from lk")
def event_link(spark, sf):
    return _event_links(spark, sf).select("pos", "cluster_idx", "event_id")


@query(f"with recursive {_LINKED} select event_id, count(*) duration_days, count(distinct pos) distinct_days from lk group by event_id")
def event_summary(spark, sf):
    return events.event_summary(_event_links(spark, sf)).drop(*SERIES_KEYS)
