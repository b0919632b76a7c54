"""SQL fragments (common table expressions) for the SQL twins of the queries.

They are written from the definitions, not from the Spark plans: offsets are joined instead
of windowed, components are propagated cell by cell, look-backs are range joins.
"""

from __future__ import annotations


def heat_index(t: str, rh: str) -> str:
    f = f"((9.0e0/5.0e0)*{t}+32.0e0)"
    return f"""((5.0e0/9.0e0)*((case when {f} < 80.0 then
 0.5e0*({f}+61.0e0+({f}-68.0e0)*1.2e0+{rh}*0.094e0)
 else -42.379e0+2.04901523e0*{f}+10.14333127e0*{rh}-0.22475541e0*{f}*{rh}-0.00683783e0*{f}*{f}
 -0.05481717e0*{rh}*{rh}+0.00122874e0*{f}*{f}*{rh}+0.00085282e0*{f}*{rh}*{rh}-0.00000199e0*{f}*{f}*{rh}*{rh}
 + (case when {rh} < 13 and {f} <= 112 then -((13.0e0-{rh})/4.0e0)*sqrt((17.0e0-abs({f}-95.0e0))/17.0e0) else 0.0e0 end)
 + (case when {rh} > 85 and {f} <= 87 then (({rh}-85.0e0)/10.0e0)*((87.0e0-{f})/5.0e0) else 0.0e0 end)
 end)-32.0e0))"""


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
        f"*pow(sin(radians({lon2}-{lon1})/2),2))"
    )
    return f"(2*6371.0*atan2(sqrt({a}),sqrt(greatest(0.0,1.0-{a}))))"


def hazen(s: str, n: str, p: str) -> str:
    rank = f"least(greatest({p}/100.0e0*{n}+0.5e0,1.0e0),{n}::double)"
    return (
        f"({s}[floor({rank})::int]::double+({rank}-floor({rank}))*"
        f"({s}[ceil({rank})::int]::double-{s}[floor({rank})::int]::double))"
    )


CELL_DAY = f"""cd0 as (
 select cast(l_shipdate as date) d, cast(l_suppkey // 10 as integer) r, cast(l_suppkey % 10 as integer) c,
  avg(l_quantity) t, avg(cast(round(l_discount*100) as integer))*10.0e0 rh
 from lineitem group by all),
cell_day as (select d, r, c, cast({heat_index('t', 'rh')} as float) hi, cast(t as float) t2 from cd0),
vals as (
 select 'hi' measure, d, r, c, hi v from cell_day where month(d) between 5 and 9
 union all select 't', d, r, c, t2 from cell_day where month(d) between 5 and 9)"""


def thresholds(pcts: tuple[float, ...]) -> str:
    values = ",".join(f"({p}::double)" for p in pcts)
    return f"""pcts(pct) as (values {values}),
lists as (select measure, cast(month(d) as integer) mon, r, c, list_sort(list(v)) s, count(v) n from vals group by all),
thr as (select measure, pct, mon, r, c, cast({hazen('s', 'n', 'pct')} as float) thr from lists, pcts)"""


def mag(pcts: tuple[float, ...]) -> str:
    return f"""{CELL_DAY},
{thresholds(pcts)},
mag as (
 select v.measure, pct, d, v.r, v.c, v.v - thr mag
 from vals v join thr k on v.measure=k.measure and month(v.d)=k.mon and v.r=k.r and v.c=k.c
 where v.v - thr > 0)"""


def domain_days(pcts: tuple[float, ...]) -> str:
    return f"""{mag(pcts)},
cal as (select m.measure, p.pct, d from (select distinct d from cell_day where month(d) between 5 and 9) x,
 (values ('t'),('hi')) m(measure), pcts p),
daily as (select measure, pct, d, count(*) n, avg(mag) m from mag group by all),
days0 as (select cal.measure, cal.pct, cal.d, coalesce(n,0) n, m from cal left join daily using (measure, pct, d)),
days as (
 select measure, pct, d, n, m*n/(select count(*) from supplier) hsci,
  n > avg(n) over (partition by measure, pct) is_hw
 from days0)"""


def hw_days(pcts: tuple[float, ...]) -> str:
    return f"""{domain_days(pcts)},
pos as (select *, year(d) y, row_number() over (partition by measure, pct, year(d) order by d) p from days),
hot as (select *, p - lag(p) over (partition by measure, pct, y order by d) g from pos where is_hw),
isl as (select *, sum(case when g<=2 then 0 else 1 end) over (partition by measure, pct, y order by d) i from hot),
big as (select measure, pct, y, i, row_number() over (partition by measure, pct order by y, i) event
 from isl group by measure, pct, y, i having count(*) >= 3),
hw as (select isl.measure, isl.pct, isl.d, hsci, n, event from isl join big using (measure, pct, y, i))"""


SHAPE = "g as (select cast(max(p_partkey)//50+1 as integer) ny, 50 nx from part)"

RASTER = f"""{SHAPE},
raster as (
 select cast(date_trunc('quarter', l_shipdate) as date) d, cast(l_partkey//50 as integer) r,
  cast(l_partkey%50 as integer) c, cast(avg(l_quantity) as float) mag
 from lineitem group by all),
disk1(dr,dc) as (values (0,0),(0,1),(0,-1),(1,0),(-1,0)),
disk2(dr,dc) as (values (0,0),(0,1),(0,2),(0,-1),(0,-2),(1,-1),(1,0),(1,1),(-1,-1),(-1,0),(-1,1),(2,0),(-2,0))"""


def erode(out: str, src: str, disk: str) -> str:
    return f"""{out} as (
 select q.d, q.r, q.c from (select x.d, x.r, x.c, x.r+dr nr, x.c+dc nc from {src} x, {disk}) q
 join g on nr between 0 and ny-1 and nc between 0 and nx-1
 left join {src} y on y.d=q.d and y.r=nr and y.c=nc
 group by q.d, q.r, q.c having count(y.d)=count(*))"""


def dilate(out: str, src: str, disk: str) -> str:
    return f"""{out} as (
 select distinct x.d, cast(x.r+dr as integer) r, cast(x.c+dc as integer) c from {src} x, {disk}, g
 where x.r+dr between 0 and ny-1 and x.c+dc between 0 and nx-1)"""


def smooth(src: str, out: str, opened: str | None = None) -> str:
    opened = opened or f"{out}_o"
    return ",\n".join(
        [
            erode(f"{out}_e", src, "disk1"),
            dilate(opened, f"{out}_e", "disk1"),
            dilate(f"{out}_d", opened, "disk2"),
            erode(out, f"{out}_d", "disk2"),
        ]
    )


def components(src: str, out: str) -> str:
    """Labels by spreading the smallest cell number between touching row runs until nothing changes."""
    return f"""{out}_s as (select d, r, c, c - row_number() over (partition by d, r order by c) k from {src}),
{out}_n as (select d, r, min(c) c0, max(c) c1, r*50+min(c) cell from {out}_s group by d, r, k),
{out}_a as (
 select x.d, x.cell, y.cell nb from {out}_n x join {out}_n y on x.d=y.d and (y.r=x.r-1 or y.r=x.r+1)
  and x.c0<=y.c1+1 and y.c0<=x.c1+1),
{out}_p(d, cell, lab) using key (d, cell) as (
 select d, cell, cell from {out}_n
 union
 select a.d, a.nb, min(u.lab) from {out}_p u join {out}_a a on a.d=u.d and a.cell=u.cell
  join recurring.{out}_p k on k.d=a.d and k.cell=a.nb where u.lab < k.lab group by a.d, a.nb),
{out} as (
 select d, r, cast(unnest(generate_series(c0, c1)) as integer) c, cast(lab as bigint) comp from {out}_n join {out}_p using (d, cell))"""


def closure(nodes: str, edges: str, out: str) -> str:
    """Smallest connected node: ``nodes(d, id)``, symmetric ``edges(d, a, b)``."""
    return f"""{out}(d, id, lab) using key (d, id) as (
 select d, id, id from {nodes}
 union
 select e.d, e.b, min(u.lab) from {out} u join {edges} e on e.d=u.d and e.a=u.id
  join recurring.{out} k on k.d=e.d and k.id=e.b where u.lab < k.lab group by e.d, e.b)"""


def centroids(src: str, out: str) -> str:
    """Component size, centroid, and the cell and position the centroid falls in."""
    return f"""{out} as (
 select *, 25.0e0+pr*0.05e0 lat, -100.0e0+pc*0.05e0 lon from (
  select d, comp, n_cells, cen_r, cen_c,
   cast(least(greatest(floor(cen_r+1.5),1),ny)-1 as integer) pr, cast(least(greatest(floor(cen_c+1.5),1),nx)-1 as integer) pc
  from (select d, comp, count(*) n_cells, sum(r)/count(*) cen_r, sum(c)/count(*) cen_c from {src} group by d, comp), g))"""


def linkage(points: str, out: str, cutoff: float) -> str:
    """Single-linkage clusters of ``points(d, comp, lat, lon)`` as ``out(d, comp, cluster)``."""
    dist = haversine("x.lat", "x.lon", "y.lat", "y.lon")
    return f"""{out}_n as (select d, comp id from {points}),
{out}_e as (
 select x.d, x.comp a, y.comp b from {points} x join {points} y on x.d=y.d and x.comp<>y.comp where {dist} <= {cutoff}),
{closure(out + '_n', out + '_e', out + '_l')},
{out} as (select d, id comp, lab cluster from {out}_l)"""


def hull(cells: str, out: str) -> str:
    """Hull of ``cells(d, cluster, r, c)`` as row runs.

    The boundary of a hull at a height is the extreme over all straight lines between two of
    its points on either side of that height. Units are half cells; cells count with the
    midpoints of their four edges.
    """
    return f"""{out}_x as (select d, cluster, r, min(c) c0, max(c) c1 from {cells} group by all),
{out}_l as (
 select d, cluster, y, min(x) x from (
  select d, cluster, 2*r-1 y, 2*c0 x from {out}_x union all select d, cluster, 2*r+1, 2*c0 from {out}_x
  union all select d, cluster, 2*r, 2*c0-1 from {out}_x) group by all),
{out}_h as (
 select d, cluster, y, max(x) x from (
  select d, cluster, 2*r-1 y, 2*c1 x from {out}_x union all select d, cluster, 2*r+1, 2*c1 from {out}_x
  union all select d, cluster, 2*r, 2*c1+1 from {out}_x) group by all),
{out}_r as (select d, cluster, unnest(generate_series(min(r), max(r))) r from {out}_x group by d, cluster),
{out}_lo as (
 select t.d, t.cluster, t.r, min(case when q.y=p.y then p.x::double else p.x+(q.x-p.x)*(2*t.r-p.y)/(q.y-p.y)::double end) x
 from {out}_r t join {out}_l p on p.d=t.d and p.cluster=t.cluster and p.y<=2*t.r
 join {out}_l q on q.d=t.d and q.cluster=t.cluster and q.y>=2*t.r group by all),
{out}_hi as (
 select t.d, t.cluster, t.r, max(case when q.y=p.y then p.x::double else p.x+(q.x-p.x)*(2*t.r-p.y)/(q.y-p.y)::double end) x
 from {out}_r t join {out}_h p on p.d=t.d and p.cluster=t.cluster and p.y<=2*t.r
 join {out}_h q on q.d=t.d and q.cluster=t.cluster and q.y>=2*t.r group by all),
{out} as (
 select d, cluster, cast(r as integer) r, cast(ceil(a.x/2-1e-9) as integer) c0, cast(floor(b.x/2+1e-9) as integer) c1
 from {out}_lo a join {out}_hi b using (d, cluster, r))"""


PATIENTS = """pat as (
 select o_orderkey row_id, lpad(cast(s as varchar),5,'0') zip, o_orderdate admit_ts, discharge_ts,
  cast(o_orderdate as date) admit
 from orders left join (select l_orderkey o_orderkey, min(l_suppkey) s, min(l_shipdate) discharge_ts
  from lineitem group by 1) using (o_orderkey))"""

CENTROIDS = """cen as (
 select lpad(cast(s_suppkey as varchar),5,'0') zip,
  case when s_nationkey<>7 then 25.0e0+(s_suppkey//10)*0.1e0+(s_suppkey//10)*(s_suppkey//10)*0.0005e0+s_acctbal/100000.0e0 end lat,
  case when s_nationkey<>7 then -100.0e0+(s_suppkey%10)*0.1e0+(s_suppkey%10)*(s_suppkey%10)*0.0005e0-s_acctbal/100000.0e0 end lon
 from supplier)"""

CELL_AXES = """ar as (select distinct cast(s_suppkey//10 as integer) idx,
 25.0e0+(s_suppkey//10)*0.1e0+(s_suppkey//10)*(s_suppkey//10)*0.0005e0 coord from supplier),
ac as (select distinct cast(s_suppkey%10 as integer) idx,
 -100.0e0+(s_suppkey%10)*0.1e0+(s_suppkey%10)*(s_suppkey%10)*0.0005e0 coord from supplier)"""

WINDOWS = f"""{CELL_AXES},
{CENTROIDS},
nr as (select zip, arg_min(idx, {{'g': abs(coord-lat), 'i': idx}}) rn from cen, ar where lat is not null group by zip),
nc as (select zip, arg_min(idx, {{'g': abs(coord-lon), 'i': idx}}) cn from cen, ac where lon is not null group by zip),
win as (
 select zip, lat, lon, rn r_near, cn c_near,
  cast(greatest(rn-1,0) as integer) r0, cast(least(rn+1,(select max(idx) from ar)) as integer) r1,
  cast(greatest(cn-1,0) as integer) c0, cast(least(cn+1,9) as integer) c1
 from cen join nr using (zip) join nc using (zip))"""


def zip_days(pcts: tuple[float, ...]) -> str:
    """ZIP exposure per day: T on the days of an event, HI on all days."""
    km = haversine("lat", "lon", "ar.coord", "ac.coord")
    return f"""{hw_days(pcts)},
{WINDOWS},
zcell as (
 select w.zip, ar.idx r, ac.idx c, {km} km from win w join ar on ar.idx between r0 and r1 join ac on ac.idx between c0 and c1),
zall as (select m.measure, pct, zip, d, mag, km, m.r, m.c from mag m join zcell z on m.r=z.r and m.c=z.c),
zhi as (
 select pct, zip, d, avg(mag) v, arg_min({{'km': km, 'mag': mag}}, {{'km': km, 'r': r, 'c': c}}) near
 from zall where measure='hi' group by all),
zt as (
 select z.pct, zip, z.d, avg(mag) v from zall z join hw on hw.measure='t' and hw.pct=z.pct and hw.d=z.d
 where z.measure='t' group by all)"""


def exposure(pcts: tuple[float, ...]) -> str:
    """Admissions times percentiles, with the ZIP's window or NULL."""
    return f"""{zip_days(pcts)},
{PATIENTS},
adm as (select p.*, pct, w.zip is not null zoned from pat p cross join pcts left join win w using (zip))"""
