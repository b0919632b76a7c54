"""Queries on scalar functions, text, dates, scans and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from swelter.functions import dates, numeric, text, thermo
from swelter.operators import climatology, grid, zips
from swelter.plans import bindings as b
from swelter.plans import sqltext as q
from swelter.plans.registry import query
from swelter.sources.tables import drop_unnamed

LINE = ["l_orderkey", "l_linenumber"]


@query("select l_orderkey, l_linenumber, round(6.112e0*exp(17.67e0*l_quantity/(l_quantity+243.5e0)),6) svp from lineitem")
def svp(spark, sf):
    line = b.table(spark, sf, "lineitem")
    return line.select(*LINE, F.round(thermo.saturation_vapour_pressure(F.col("l_quantity")), 6).alias("svp"))


@query("""select l_orderkey, l_linenumber, round(100.0e0*exp(17.67e0*td/(td+243.5e0))/exp(17.67e0*t/(t+243.5e0)),6) rh
from (select l_orderkey, l_linenumber, l_quantity t, l_quantity-2*round(l_discount*100) td from lineitem)""")
def relative_humidity(spark, sf):
    line = b.table(spark, sf, "lineitem")
    td = F.col("l_quantity") - F.round(F.col("l_discount") * 100) * 2
    return line.select(*LINE, F.round(thermo.relative_humidity(td, F.col("l_quantity")), 6).alias("rh"))


@query(f"""select l_orderkey, l_linenumber, round({q.heat_index('t', 'rh')},6) hi
from (select l_orderkey, l_linenumber, l_quantity t, 10.0e0*round(l_discount*100) rh from lineitem)""")
def heat_index(spark, sf):
    line = b.table(spark, sf, "lineitem")
    rh = F.round(F.col("l_discount") * 100) * 10.0
    return line.select(*LINE, F.round(thermo.heat_index_c(F.col("l_quantity"), rh), 6).alias("hi"))


@query(f"""select l_orderkey, l_linenumber, round({q.haversine('la', 'lo', 'lb', 'lob')},6) km from (
select l_orderkey, l_linenumber, 25+(l_suppkey//10)*0.1e0 la, -100+(l_suppkey%10)*0.1e0 lo,
 25+(l_partkey//50)*0.05e0 lb, -100+(l_partkey%50)*0.05e0 lob from lineitem)""")
def haversine(spark, sf):
    line = b.table(spark, sf, "lineitem")
    sr, sc = F.floor(F.col("l_suppkey") / 10), F.col("l_suppkey") % 10
    pr, pc = F.floor(F.col("l_partkey") / 50), F.col("l_partkey") % 50
    km = numeric.haversine_km(sr * 0.1 + 25, sc * 0.1 - 100, pr * 0.05 + 25, pc * 0.05 - 100)
    return line.select(*LINE, F.round(km, 6).alias("km"))


@query("""select l_orderkey, l_linenumber, cast(floor(l_quantity/4+0.5) as bigint) n from lineitem""")
def round_half_up(spark, sf):
    line = b.table(spark, sf, "lineitem")
    return line.select(*LINE, numeric.round_half_up(F.col("l_quantity") / 4).alias("n"))


@query("""select l_suppkey, count(*) n_rows, count(v) n_values, round(avg(v),6) mean_v from (
select l_suppkey, nullif(case when l_discount<0.02 then -9999.0 else l_quantity end, -9999.0) v from lineitem) group by 1""")
def scan_nullif_sentinel(spark, sf):
    raw = F.when(F.col("l_discount") < 0.02, F.lit(-9999.0)).otherwise(F.col("l_quantity"))
    line = b.table(spark, sf, "lineitem").select("l_suppkey", numeric.nodata_to_null(raw).alias("v"))
    return line.groupBy("l_suppkey").agg(
        F.count("*").alias("n_rows"), F.count("v").alias("n_values"), F.round(F.avg("v"), 6).alias("mean_v")
    )


@query("""select cast(l_suppkey//10 as integer) r, cast(l_suppkey%10 as integer) c, count(*) n, max(l_quantity) t_max
from lineitem where l_suppkey between 20 and 59 group by all""")
def row_block_scan(spark, sf):
    """A block of grid rows; the bounds on the stored key reach the Parquet scan."""
    lo, hi = 2 * b.CELL_COLS, 6 * b.CELL_COLS - 1
    block = b.table(spark, sf, "lineitem").where(F.col("l_suppkey").between(lo, hi))
    return block.groupBy(
        F.floor(F.col("l_suppkey") / b.CELL_COLS).cast("int").alias("r"), (F.col("l_suppkey") % b.CELL_COLS).cast("int").alias("c")
    ).agg(F.count("*").alias("n"), F.max("l_quantity").alias("t_max"))


@query(f"""with {q.CELL_DAY} select d, r, c, round(t2::double,4) t2 from cell_day where month(d) between 5 and 9""")
def filter_mjjas(spark, sf):
    cells = b.cell_day(spark, sf).where(dates.in_season(F.col("d")))
    return cells.select("d", "r", "c", F.round(F.col("t2").cast("double"), 4).alias("t2"))


@query("""select 'row' axis, cast(i as integer) idx, round(cast(cast(49.0e0+(i+0.5e0)*-0.05e0 as float) as double),6) coord
from (select unnest(range(max(p_partkey)//50+1)) i from part)
union all select 'col', cast(i as integer), round(cast(cast(-125.0e0+(i+0.5e0)*0.05e0 as float) as double),6)
from (select unnest(range(max(p_partkey%50)+1)) i from part)""")
def grid_axes(spark, sf):
    """Cell centres of the part grid from its affine transform (rows run southwards)."""
    shape = b.raster_shape(spark, sf)
    rows = grid.affine_axis(spark, shape.ny, 49.0, -0.05).withColumn("axis", F.lit("row"))
    cols = grid.affine_axis(spark, shape.nx, -125.0, 0.05).withColumn("axis", F.lit("col"))
    return rows.unionByName(cols).select("axis", "idx", F.round("coord", 6).alias("coord"))


@query(f"""with {q.CELL_AXES}, n as (select max(idx)+1.0 n from ar),
p as (select l_orderkey, l_linenumber, least(greatest(l_suppkey//10+l_discount*15, 1), n) x from lineitem, n)
select l_orderkey, l_linenumber, round(a.coord+coalesce((x-floor(x))*(z.coord-a.coord),0),6) lat
from p join ar a on a.idx=floor(x)-1 left join ar z on z.idx=a.idx+1""")
def interp_axis(spark, sf):
    rows, _ = b.cell_axes(spark, sf)
    line = b.table(spark, sf, "lineitem").select(
        *LINE, (F.floor(F.col("l_suppkey") / 10) + F.col("l_discount") * 15).alias("x")
    )
    return grid.interp_axis(line, rows, "x", "lat").select(*LINE, F.round("lat", 6).alias("lat"))


@query(f"""with {q.CELL_AXES},
p as (select c_custkey, 25+c_acctbal/7000 y, -99.9+c_acctbal/9000 x from customer),
a as (select c_custkey, arg_min(idx, {{'g': abs(coord-y), 'i': idx}}) r from p, ar group by 1),
z as (select c_custkey, arg_min(idx, {{'g': abs(coord-x), 'i': idx}}) c from p, ac group by 1)
select c_custkey, r, c from a join z using (c_custkey)""")
def nearest_cell(spark, sf):
    rows, cols = b.cell_axes(spark, sf)
    at = b.table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 7000 + 25).alias("y"), (F.col("c_acctbal") / 9000 - 99.9).alias("x")
    )
    near = grid.nearest_index(grid.nearest_index(at, rows, "y", "r"), cols, "x", "c")
    return near.select("c_custkey", "r", "c")


@query(f"""with {q.CELL_AXES} select (select count(*) from ar) nlat, (select count(*) from ac) nlon,
round((select arg_min(coord, idx) from ar),6) lat0, round((select arg_max(coord, idx) from ar),6) lat1,
round((select arg_min(coord, idx) from ac),6) lon0, round((select arg_max(coord, idx) from ac),6) lon1""")
def grid_signature(spark, sf):
    sig = grid.grid_signature(*b.cell_axes(spark, sf))
    ends = [F.round(c, 6).alias(c) for c in ("lat0", "lat1", "lon0", "lon1")]
    return sig.select("nlat", "nlon", *ends)


@query(f"""with {q.RASTER} select d, cast(c*ny+r as bigint) idx from raster, g""")
def flat_index(spark, sf):
    shape = b.raster_shape(spark, sf)
    return b.raster(spark, sf).select("d", grid.flat_index(F.col("r"), F.col("c"), shape.ny).cast("bigint").alias("idx"))


# --- dates and text ---------------------------------------------------------------------------

_NAME_SQL = """case o_orderkey%5 when 0 then 'tmax_'||strftime(o_orderdate,'%Y%m%d')||'.bil'
 when 1 then 'run1'||strftime(o_orderdate,'%Y%m%d')||'_x' when 2 then strftime(o_orderdate,'%Y')||'1340_bad'
 when 3 then strftime(o_orderdate,'%Y%m%d')||'-'||strftime(o_orderdate + interval 400 day,'%Y%m%d')
 else o_orderstatus end"""


@query(f"""with s as (select o_orderkey, list_filter(regexp_extract_all({_NAME_SQL},'[0-9]+'),
  lambda x: length(x)=8 and (x like '19%' or x like '20%')) m from orders),
t as (select o_orderkey, unnest(m) tok, unnest(range(len(m))) pos from s),
v as (select o_orderkey, pos, cast(try_strptime(tok,'%Y%m%d') as date) d from t)
select d, cast(first_row as bigint) first_row, cast(first_pos as integer) first_pos from (
 select d, o_orderkey first_row, pos first_pos, row_number() over (partition by d order by o_orderkey, pos) rn
 from v where d is not null) where rn=1""")
def dates_from_strings(spark, sf):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    kind = F.col("o_orderkey") % 5
    name = (
        F.when(kind == 0, F.concat(F.lit("tmax_"), day, F.lit(".bil")))
        .when(kind == 1, F.concat(F.lit("run1"), day, F.lit("_x")))
        .when(kind == 2, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("1340_bad")))
        .when(kind == 3, F.concat(day, F.lit("-"), F.date_format(F.date_add("o_orderdate", 400), "yyyyMMdd")))
        .otherwise(F.col("o_orderstatus"))
    )
    names = b.table(spark, sf, "orders").select("o_orderkey", name.alias("name"))
    return dates.dates_from_strings(names, "name", "o_orderkey")


@query("""select o_orderkey, case when o_orderkey%3=2 and o_orderkey%2=0 then null else cast(o_orderdate as date) end d from orders""")
def parse_dates_mixed(spark, sf):
    """A third of the dates as day numbers, a third as ISO text, the rest half compact, half junk."""
    o = b.table(spark, sf, "orders")
    kind, day = F.col("o_orderkey") % 3, F.col("o_orderdate").cast("date")
    number = F.when(kind == 0, F.unix_date(day) + 719529.25)
    words = F.when(kind == 1, F.date_format(day, "yyyy-MM-dd")).when(
        kind == 2, F.when(F.col("o_orderkey") % 2 == 0, F.lit("unknown")).otherwise(F.date_format(day, "yyyyMMdd"))
    )
    return o.select("o_orderkey", dates.parse_dates_mixed(number, words).alias("d"))


@query("""select o_orderkey, case when o_orderkey%11 in (3,5) then null else cast(o_orderdate as date) end d from orders""")
def parse_date_safe(spark, sf):
    o = b.table(spark, sf, "orders")
    kind = F.col("o_orderkey") % 11
    raw = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(kind == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(kind == 2, F.concat(F.lit("  "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit("\t")))
        .when(kind == 3, F.lit(" N/A "))
        .when(kind == 4, F.date_format("o_orderdate", "MMM d, yyyy"))
        .when(kind == 6, F.date_format("o_orderdate", "M/d/yy"))
        .when(kind == 7, F.concat(F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" 5:30 PM")))
        .when(kind == 8, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 05:30:00.5")))
        .when(kind == 9, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T05:30:00Z")))
        .when(kind == 10, F.date_format("o_orderdate", "MM.dd.yyyy"))
        .otherwise(F.concat(F.lit("on "), F.col("o_orderstatus")))
    )
    return o.select("o_orderkey", dates.parse_date_safe(raw).cast("date").alias("d"))


@query("""select o_orderkey, cast(strftime(o_orderdate,'%Y%m%d') as integer) n,
cast(strptime(strftime(o_orderdate,'%Y%m%d'),'%Y%m%d') as date) d from orders""")
def yyyymmdd_roundtrip(spark, sf):
    n = dates.to_yyyymmdd(F.col("o_orderdate"))
    o = b.table(spark, sf, "orders").select("o_orderkey", n.alias("n"))
    return o.withColumn("d", dates.from_yyyymmdd(F.col("n").cast("double")))


@query("""select o_orderkey, date '1970-01-01' + cast(o_orderkey%20000 as integer) d from orders""")
def datenum_to_date(spark, sf):
    number = F.col("o_orderkey") % 20000 + F.lit(719529.75)
    return b.table(spark, sf, "orders").select("o_orderkey", dates.datenum_to_date(number).alias("d"))


@query("""select c_custkey, case when c_custkey%4=3 then cast(c_custkey+1000000 as varchar)
 else lpad(cast(c_custkey as varchar),5,'0') end zip from customer""")
def normalize_zip(spark, sf):
    kind, key = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    raw = (
        F.when(kind == 0, key)
        .when(kind == 1, F.concat(key, F.lit(".0")))
        .when(kind == 2, F.concat(F.lit(" "), key, F.lit(" ")))
        .otherwise((F.col("c_custkey") + 1000000).cast("string"))
    )
    return b.table(spark, sf, "customer").select("c_custkey", text.normalize_zip(raw).alias("zip"))


@query("""select lpad(cast(c_custkey as varchar),5,'0') zip, case when c_custkey%7<>0 then round(25+c_acctbal/7000,6) end lat,
round(-100+c_acctbal/9000,6) lon from customer""")
def zip_centroids(spark, sf):
    raw = b.table(spark, sf, "customer").select(
        F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("Zip Code"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a"))
        .otherwise((F.col("c_acctbal") / 7000 + 25).cast("string")).alias("LATITUDE"),
        (F.col("c_acctbal") / 9000 - 100).alias("Lng"),
    )
    return zips.zip_centroids(raw).select("zip", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("""select zip, c_custkey, lat, lon from (
select lpad(cast(c_nationkey as varchar),5,'0') zip, c_custkey, round(c_acctbal,2) lat, round(-c_acctbal,2) lon,
 row_number() over (partition by c_nationkey order by c_custkey desc) rn from customer) where rn=1""")
def zip_dedupe_last(spark, sf):
    rows = b.table(spark, sf, "customer").select(
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("zip"), "c_custkey",
        F.round("c_acctbal", 2).alias("lat"), F.round(-F.col("c_acctbal"), 2).alias("lon"),
    )
    return zips.last_per_zip(rows, "c_custkey")


@query("""select o_orderkey, cast(year(o_orderdate) as integer) admit_year, cast(month(o_orderdate) as integer) admit_month,
cast(dayofyear(o_orderdate) as integer) admit_dayofyear, cast(dayofweek(o_orderdate)+1 as integer) admit_weekday from orders""")
def admit_parts(spark, sf):
    parts = dates.admit_parts(F.col("o_orderdate").cast("date"))
    return b.table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query(f"""with {q.PATIENTS}, x as (select row_id, date_diff('day', admit_ts, discharge_ts) raw from pat)
select row_id, cast(case when raw>=0 then raw end as double) length_of_stay_days,
cast(case when raw>=0 then cast(raw>=3 as integer) end as double) long_stay_3plus,
cast(coalesce(cast(raw<0 as integer),0) as double) invalid_length_of_stay from x""")
def length_of_stay(spark, sf):
    stay = dates.length_of_stay(F.col("admit_ts"), F.col("discharge_ts"))
    return b.patients(spark, sf).select("row_id", *[c.alias(n) for n, c in stay.items()])


@query(f"""with {q.PATIENTS} select row_id, trim(zip) zip5, admit_ts, discharge_ts from pat""")
def patient_scan(spark, sf):
    """Admission file as exported: an index column to drop, blanks around the ZIP."""
    raw = b.patients(spark, sf).select(
        F.col("row_id").alias("Unnamed: 0"), "row_id", F.concat(F.lit(" "), "zip", F.lit(" ")).alias("zip5"), "admit_ts",
        "discharge_ts",
    )
    return drop_unnamed(raw).withColumn("zip5", dates.strip(F.col("zip5")))


@query(f"""with {q.PATIENTS} select distinct zip from pat where zip is not null""")
def distinct_zips(spark, sf):
    return zips.distinct_zips(b.patients(spark, sf))


@query("""select distinct l_suppkey, cast(o_orderdate as date) d from orders join lineitem on l_orderkey = o_orderkey
except select l_suppkey, cast(l_shipdate as date) from lineitem""")
def missing_days_anti_join(spark, sf):
    """Days on which a supplier gets orders but ships nothing."""
    line, orders = b.table(spark, sf, "lineitem"), b.table(spark, sf, "orders")
    ordered = line.join(orders, line.l_orderkey == orders.o_orderkey)
    days = lambda df, name: df.select("l_suppkey", F.col(name).cast("date").alias("d"))
    return climatology.missing_days(days(ordered, "o_orderdate"), days(line, "l_shipdate"), ("l_suppkey", "d"))
