"""Queries for sources and sinks: what is written is read back and compared."""

import os
import uuid

from pyspark.sql import functions as F

from terralane.operators import measures as M
from terralane.operators.accumulate import attach_row
from terralane.plans.joins import boxed
from terralane.plans.layers import notched, rounded
from terralane.plans.registry import query
from terralane.session import checkpoint_root
from terralane.sources import elements as E
from terralane.sources import features as S
from terralane.sources import scenes as C
from terralane.sources.database import sql_query


def fresh_folder(fx) -> str:
    """A new folder in the shared scratch location."""
    return os.path.join(checkpoint_root(fx.spark), "layers-" + uuid.uuid4().hex)


PARCEL = "select id, kind, minx, miny, maxx, maxy, (maxx-minx)*(maxy-miny)-(maxy-miny-2) as area, 3857 as srid from fx_parcels"


@query("geojson_round_trip_s1", PARCEL)
def _(fx):
    path = fresh_folder(fx)
    S.write_features(notched(fx).select("id", "kind", "geom"), path, "geojson")
    back = S.load_features(fx.spark, path, "geojsonl", properties="id bigint, kind bigint")
    return M.measure_area(back, "sqdeg").drop("geom")


@query("load_points_csv_s2", "select id, round(x,9) as x, round(y,9) as y, v from fx_places where v>0")
def _(fx):
    path = fresh_folder(fx)
    pts = fx.places.select("id", F.col("x").alias("Longitude"), F.col("y").alias("LAT"),
                           F.when(F.col("v") > 0, F.col("v")).alias("v"))
    S.write_features(pts, path, "csv")
    back = S.load_points_csv(fx.spark, path, "v")
    return rounded(back.withColumn("id", F.col("id").cast("long")), 9, "x", "y")


@query("cells_round_trip_s5", """
select band, r, c, case when v<600 then null else v end as v from fx_bands""")
def _(fx):
    path = fresh_folder(fx)
    low = fx.bands.withColumn("v", F.when(F.col("v") >= 600, F.col("v")))
    S.write_cells(low, path, rows_per_tile=8, nodata=-9999.0)
    cells, _ = S.load_cells(fx.spark, path, nodata=-9999.0)
    return cells.select("band", "r", "c", "v")


@query("geoparquet_s6", PARCEL)
def _(fx):
    path = fresh_folder(fx)
    S.write_features(notched(fx), path, "parquet", compression="zstd", wkb=True)
    back = S.load_features(fx.spark, path, "parquet")
    return M.measure_area(back, "sqdeg").drop("geom").withColumn("id", F.col("id").cast("long"))


@query("write_features_s4", "select id, kind, minx, maxy from fx_parcels")
def _(fx):
    path = fresh_folder(fx)
    S.write_features(boxed(fx.parcels), path, "orc")
    return fx.spark.read.orc(path).select("id", "kind", "minx", "maxy")


@query("split_layer_s7", "select kind, count(*) as n, sum(id)::bigint as ids from fx_parcels group by kind")
def _(fx):
    path = fresh_folder(fx)
    S.split_layer(boxed(fx.parcels), path, "kind")
    back = fx.spark.read.parquet(path)
    return back.groupBy(F.col("kind").cast("long").alias("kind")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("convert_layers_s8", """
select kind, count(*) as converted, 'converted' as status, (select count(*) from fx_parcels) as reported from fx_parcels group by kind""")
def _(fx):
    src, out = fresh_folder(fx), fresh_folder(fx)
    S.write_features(fx.parcels, src, "json")
    status = S.convert_layers(fx.spark, src, out, "orc", source="json")
    total = status.groupBy("status").agg(F.sum("features").alias("reported"))
    back = fx.spark.read.orc(out).groupBy("kind").agg(F.count("*").alias("converted"))
    return attach_row(back, total)


@query("sql_query_s9", """
select d.name, count(*) as n from fx_districts d join fx_places p on p.x between d.minx and d.maxx
and p.y between d.miny and d.maxy where p.v>5000 group by d.name""")
def _(fx):
    return sql_query(fx.spark, """select d.name, count(*) as n from {d} d join {p} p on p.x between d.minx and d.maxx
        and p.y between d.miny and d.maxy where p.v > 5000 group by d.name""", d=fx.districts, p=fx.places)


def map_elements(fx):
    """Customers as nodes and parts as ways of four to six nodes, some of them unknown."""
    k = F.col("p_partkey")
    none = F.lit(None)
    nodes = fx.places.select(
        F.lit("node").alias("type"), "id", F.col("x").alias("lon"), F.col("y").alias("lat"),
        none.cast("array<bigint>").alias("nodes"),
        F.when(F.col("id") % 10 == 3, F.create_map(F.lit("amenity"), F.lit("cafe"), F.lit("name"), F.concat(F.lit("cafe "), F.col("id").cast("string"))))
        .alias("tags"))
    refs = F.transform(F.sequence(F.lit(0), 3 + k % 3), lambda i: (k + i * i * 7 + i * 3) % 2300)
    ways = fx.part.select(
        F.lit("way").alias("type"), (k + 1000000).alias("id"), none.cast("double").alias("lon"), none.cast("double").alias("lat"),
        refs.alias("nodes"), F.create_map(F.lit("building"), F.lit("yes"), F.lit("leisure"), F.when(k % 4 == 0, F.lit("park")))
        .alias("tags"))
    return nodes.unionByName(ways)


WAYS = """rf as (select p_partkey as k, i, (p_partkey+i*i*7+i*3)%2300 as n from part cross join (select unnest(generate_series(0,5)) as i) where i<=3+p_partkey%3),
pv as (select k, p.x, p.y, row_number() over (partition by k order by i) as i, count(*) over (partition by k) as m from rf join fx_places p on p.id=rf.n),
cl as (select k, i, x, y, m, coalesce(lead(x) over (partition by k order by i), first_value(x) over (partition by k order by i)) as qx,
 coalesce(lead(y) over (partition by k order by i), first_value(y) over (partition by k order by i)) as qy from pv where m>=3),
wy as (select k, any_value(m) as m, abs(sum((x-116.5e0)*(qy-40)-(qx-116.5e0)*(y-40)))/2 as area, sum(x) as sx, sum(y) as sy,
 min_by(x,i) as fx, min_by(y,i) as fy from cl group by k)"""


@query("assemble_ways_s10", f"with {WAYS} select k+1000000 as id, round(area,8) as area, m+1 as vertices from wy where area>1e-12")
def _(fx):
    out = M.measure_area(E.assemble_ways(map_elements(fx)), "sqdeg")
    return out.filter("area > 1e-12").select("id", F.round("area", 8).alias("area"),
                                             F.size(F.col("geom.rings")[0]).cast("long").alias("vertices"))


@query("extract_pois_s11", f"""
with {WAYS} select id, concat('cafe ', id) as name, round(x,9) as x, round(y,9) as y from fx_places where id%10=3 union all
select k+1000000, '', round((sx+fx)/(m+1),9), round((sy+fy)/(m+1),9) from wy where area>1e-12 and k%4=0""")
def _(fx):
    out = E.extract_pois(map_elements(fx))
    return rounded(out, 9, "x", "y").select("id", "name", "x", "y")


def scene_items(fx):
    k = F.col("o_orderkey")
    x, y = ((k * 7919) % 3600) / 10.0 - 180.0, ((k * 6271) % 1700) / 10.0 - 85.0
    return fx.orders.select(k.alias("id"), F.col("o_orderdate").alias("datetime"), x.alias("minx"), y.alias("miny"),
                            (x + 1.5).alias("maxx"), (y + 1.0).alias("maxy"), ((k * 13) % 100).cast("double").alias("cloud_cover"),
                            F.col("o_orderstatus").alias("collection"))


@query("search_scenes_s12", """
with s as (select o_orderkey as id, o_orderdate as d, ((o_orderkey*7919)%3600)/10.0e0-180 as x, ((o_orderkey*6271)%1700)/10.0e0-85 as y,
(o_orderkey*13)%100 as cc, o_orderstatus as col from orders)
select id, strftime(d,'%Y-%m-%d') as day, cc*1.0e0 as cloud_cover from s where x<=60 and x+1.5>=-40 and y<=50 and y+1>=-20
and d>=timestamp '1995-01-01' and d<timestamp '1997-07-01' and cc<30 and col='F' order by d desc, id limit 25""")
def _(fx):
    out = C.search_scenes(scene_items(fx), (-40, -20, 60, 50), "1995-01-01", "1997-06-30", 30, "F", 25)
    return out.select("id", F.date_format("datetime", "yyyy-MM-dd").alias("day"), "cloud_cover")


@query("scene_timeseries_a8", """
select strftime(o_orderdate,'%Y-%m-%d') as date, round(avg(l_quantity),6) as mean, count(*) as cells
from lineitem join orders on o_orderkey=l_orderkey where l_linenumber=2 and (l_partkey%360)-180 between -90 and 90
and (l_suppkey%170)-85 between -60 and 60 group by 1""")
def _(fx):
    cells = fx.lineitem.select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("band"),
                               (F.col("l_partkey") % 360 - 180).alias("x"), (F.col("l_suppkey") % 170 - 85).alias("y"),
                               F.col("l_quantity").alias("v"))
    out = C.scene_timeseries(cells, scene_items(fx), 2, (-90, -60, 90, 60))
    return rounded(out, 6, "mean").withColumn("date", F.date_format("date", "yyyy-MM-dd"))
