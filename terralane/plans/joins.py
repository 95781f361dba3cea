"""Queries for the join operators."""

from pyspark.sql import functions as F

from terralane.functions import geometry as G
from terralane.operators import joins as J
from terralane.operators.nearest import knn_join, nearest_join
from terralane.plans.registry import query

HAV = """2.0e0*6371000.0e0*asin(sqrt(least(1.0e0,
  power(sin((radians({b}.y)-radians({a}.y))/2),2)+cos(radians({a}.y))*cos(radians({b}.y))
  *power(sin((radians({b}.x)-radians({a}.x))/2),2))))"""


def hav(a="a", b="b"):
    return HAV.format(a=a, b=b)


def boxed(df):
    """Turn a table of boxes into a polygon layer."""
    return df.withColumn("geom", G.box_geometry(F.col("minx"), F.col("miny"),
                                                F.col("maxx"), F.col("maxy")))


@query("nearest_join_j3", f"""
with d as (select a.id, b.id as fid, {hav()} as dist from fx_places a cross join fx_facilities b),
r as (select *, row_number() over (partition by id order by dist, fid) as rn from d)
select id, fid as facility, round(dist,3) as dist from r where rn=1""")
def _(fx):
    out = nearest_join(fx.places, fx.facilities.select("id", "x", "y"), metric="haversine")
    return out.select("id", F.col("id_near").alias("facility"),
                      F.round("nearest_dist", 3).alias("dist"))


@query("nearest_join_bounded_j3", f"""
with d as (select a.id, b.id as fid, {hav()} as dist from fx_places a cross join fx_facilities b),
r as (select *, row_number() over (partition by id order by dist, fid) as rn from d where dist<=4000)
select id, fid as facility, round(dist,3) as dist from r where rn=1""")
def _(fx):
    pairs = knn_join(fx.places, fx.facilities, 1, 4000.0, "haversine")
    return pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("facility"),
                        F.round("dist", 3).alias("dist"))


@query("knn_join_j4", """
with d as (select a.id, b.id as nid, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as dist
  from fx_places a cross join fx_pois b),
r as (select *, row_number() over (partition by id order by dist, nid) as rn from d)
select id, nid, rn as rank, round(dist,9) as dist from r where rn<=5""")
def _(fx):
    pairs = knn_join(fx.places, fx.pois, 5)
    return pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("nid"),
                        F.col("rank").cast("long").alias("rank"), F.round("dist", 9).alias("dist"))


@query("spatial_join_j1", """
select p.id, d.name from fx_places p join fx_districts d
on p.x>=d.minx and p.x<=d.maxx and p.y>=d.miny and p.y<=d.maxy""")
def _(fx):
    pairs = J.points_in_polygons(fx.places, boxed(fx.districts))
    return pairs.select(F.col("a_id").alias("id"), F.col("b_name").alias("name"))


@query("spatial_join_features_j1", """
select a.id as id_target, b.id as id_join, a.kind from fx_parcels a join fx_zones b
on a.minx<=b.maxx and b.minx<=a.maxx and a.miny<=b.maxy and b.miny<=a.maxy""")
def _(fx):
    out = J.spatial_join(boxed(fx.parcels), boxed(fx.zones), "intersects")
    return out.select("id_target", "id_join", "kind")


@query("spatial_join_left_j1", """
select a.id as id_target, b.id as id_join from fx_parcels a left join fx_zones b
on a.minx>=b.minx and a.maxx<=b.maxx and a.miny>=b.miny and a.maxy<=b.maxy""")
def _(fx):
    out = J.spatial_join(boxed(fx.parcels), boxed(fx.zones), "within", "left")
    return out.select("id_target", "id_join")


@query("spatial_join_touches_j1", """
select a.id as id_target, b.id as id_join from fx_parcels a join fx_zones b
on a.minx<=b.maxx and b.minx<=a.maxx and a.miny<=b.maxy and b.miny<=a.maxy
and not (a.minx<b.maxx and b.minx<a.maxx and a.miny<b.maxy and b.miny<a.maxy)""")
def _(fx):
    out = J.spatial_join(boxed(fx.parcels), boxed(fx.zones), "touches")
    return out.select("id_target", "id_join")


@query("spatial_join_stats_j2", """
select d.id, d.name, count(p.id) as n_places, round(sum(p.v),2) as total_v, round(avg(p.v),6) as mean_v
from fx_districts d left join fx_places p
on p.x>=d.minx and p.x<=d.maxx and p.y>=d.miny and p.y<=d.maxy group by d.id, d.name""")
def _(fx):
    out = J.spatial_join_agg(boxed(fx.districts), fx.places, {
        "n_places": ("count", "*"), "total_v": ("sum", "v"), "mean_v": ("avg", "v")})
    return out.select("id", "name", "n_places", F.round("total_v", 2).alias("total_v"),
                      F.round("mean_v", 6).alias("mean_v"))


@query("within_distance_join_j5", f"""
with d as (select a.id as a_id, b.id as b_id, {hav()} as dist from fx_places a cross join fx_pois b)
select a_id, b_id, round(dist,3) as dist from d where dist<=1500""")
def _(fx):
    out = J.within_distance_join(fx.places, fx.pois, 1500.0)
    return out.select("a_id", "b_id", F.round("dist", 3).alias("dist"))


@query("select_by_location_p2", """
select p.id from fx_parcels p where exists (select 1 from fx_zones z where z.landuse=1
and p.minx<=z.maxx and z.minx<=p.maxx and p.miny<=z.maxy and z.miny<=p.maxy)""")
def _(fx):
    return J.select_by_location(boxed(fx.parcels), boxed(fx.zones.filter("landuse = 1"))).select("id")


@query("proximity_within_p4", f"""
select a.id from fx_places a where exists (select 1 from fx_facilities b where {hav()}<=3000)""")
def _(fx):
    return J.proximity_filter(fx.places, fx.facilities, 3000.0).select("id")


@query("proximity_outside_p4", f"""
select a.id from fx_places a where not exists (select 1 from fx_pois b where {hav()}<=1000)""")
def _(fx):
    return J.proximity_filter(fx.places, fx.pois, 1000.0, "outside").select("id")


@query("proximity_counts_p4", f"""
with k as (select a.id, exists (select 1 from fx_facilities b where {hav()}<=3000) as hit from fx_places a)
select count(*) as input_count, count(*) filter (where hit) as kept_count,
count(*) filter (where not hit) as dropped_count from k""")
def _(fx):
    return J.proximity_counts(fx.places, fx.facilities, 3000.0)


CENTERS = """c as (select id, (minx+maxx)/2 as x, (miny+maxy)/2 as y from fx_districts)"""


def centers(fx):
    return fx.districts.select("id", ((F.col("minx") + F.col("maxx")) / 2).alias("x"),
                               ((F.col("miny") + F.col("maxy")) / 2).alias("y"))


@query("distance_matrix_j6", f"""
with {CENTERS} select a.id as i, b.id as j, round({hav()}/1000.0e0,6) as dist
from fx_places a cross join c b""")
def _(fx):
    m = J.distance_matrix(fx.places, centers(fx), "haversine")
    return m.select("i", "j", F.round("dist", 6).alias("dist"))


@query("distance_matrix_mean_j6", """
select round(avg(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))),9) as mean_distance, count(*) as pairs
from fx_facilities a join fx_facilities b on a.id<b.id""")
def _(fx):
    m = J.matrix_mean(J.distance_matrix(fx.facilities, fx.facilities))
    return m.select(F.round("mean_distance", 9).alias("mean_distance"), "pairs")


@query("geocode_j7", """
with addr as (select o_orderkey as id, case when o_orderkey%3=0 then concat('  POI_', cast(o_orderkey%2500 as varchar), ' ')
  else concat('Nation_', cast(o_orderkey%30 as varchar)) end as address from orders),
g as (select trim(lower(name)) as k, min(id) as gid, min(x) as x, min(y) as y from fx_pois group by 1),
n as (select trim(lower(name)) as k, min(minx) as x, min(miny) as y from fx_districts group by 1)
select a.id, round(coalesce(g.x,n.x),9) as x, round(coalesce(g.y,n.y),9) as y,
case when g.k is not null then 0 when n.k is not null then 1 end as provider
from addr a left join g on g.k=lower(trim(a.address)) left join n on n.k=lower(trim(a.address))""")
def _(fx):
    key = F.col("o_orderkey")
    addresses = fx.orders.select(key.alias("id"), F.when(
        key % 3 == 0, F.concat(F.lit("  POI_"), (key % 2500).cast("string"), F.lit(" ")))
        .otherwise(F.concat(F.lit("Nation_"), (key % 30).cast("string"))).alias("address"))
    regions = fx.districts.select("id", "name", F.col("minx").alias("x"), F.col("miny").alias("y"))
    out = J.geocode_join(addresses, fx.pois, regions)
    return out.select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "provider")


@query("reverse_geocode_j8", f"""
with d as (select a.id, b.id as pid, b.name, {hav()} as dist from fx_places a cross join fx_pois b),
r as (select *, row_number() over (partition by id order by dist, pid) as rn from d where dist<=1500),
n as (select id, count(*) as n_places, string_agg(name, ',' order by rn) filter (where rn<=3) as places from r group by id),
g as (select p.id, min(d.name) as region from fx_places p join fx_districts d
  on p.x>=d.minx and p.x<=d.maxx and p.y>=d.miny and p.y<=d.maxy group by p.id)
select p.id, g.region, coalesce(n.n_places,0) as n_places, n.places from fx_places p
left join g on g.id=p.id left join n on n.id=p.id""")
def _(fx):
    out = J.reverse_geocode_join(fx.places, boxed(fx.districts), fx.pois, 1500.0, keep=3)
    return out.select("id", "region", "n_places", F.array_join("places", ",").alias("places"))


# roads: the five horizontal and five vertical district axes, cut at every crossing
SEGMENTS = """seg as (select n_nationkey*2 as seg, 116.0e0+(n_nationkey%5)*0.2e0 as px,
  39.6e0+floor(n_nationkey/5.0e0)*0.2e0 as py, 116.2e0+(n_nationkey%5)*0.2e0 as qx,
  39.6e0+floor(n_nationkey/5.0e0)*0.2e0 as qy from nation union all
  select n_nationkey*2+1, 116.1e0+(n_nationkey%5)*0.2e0, 39.5e0+floor(n_nationkey/5.0e0)*0.2e0,
  116.1e0+(n_nationkey%5)*0.2e0, 39.7e0+floor(n_nationkey/5.0e0)*0.2e0 from nation)"""


def segments(fx):
    col = (F.col("n_nationkey") % 5) * 0.2
    row = F.floor(F.col("n_nationkey") / 5.0) * 0.2
    across = fx.nation.select((F.col("n_nationkey") * 2).alias("seg"), (col + 116.0).alias("px"),
                              (row + 39.6).alias("py"), (col + 116.2).alias("qx"),
                              (row + 39.6).alias("qy"))
    along = fx.nation.select((F.col("n_nationkey") * 2 + 1).alias("seg"), (col + 116.1).alias("px"),
                             (row + 39.5).alias("py"), (col + 116.1).alias("qx"),
                             (row + 39.7).alias("qy"))
    return across.unionAll(along)


@query("map_match_j9", f"""
with {SEGMENTS},
t as (select t.track, t.id, t.tm, s.seg, t.x, t.y, s.px, s.py, s.qx-s.px as dx, s.qy-s.py as dy
  from fx_track t cross join seg s),
u as (select *, greatest(0.0e0, least(1.0e0, ((x-px)*dx+(y-py)*dy)/(dx*dx+dy*dy))) as f from t),
d as (select track, id, tm, seg, sqrt(power(x-(px+f*dx),2)+power(y-(py+f*dy),2)) as dist from u),
r as (select *, row_number() over (partition by track, id order by dist, seg) as rn from d where dist<=0.03)
select track, id, seg, round(dist,9) as dist from r where rn=1""")
def _(fx):
    out = J.map_match(fx.track, segments(fx), 0.03)
    return out.select("track", "id", "seg", F.round("dist", 9).alias("dist"))


@query("map_match_continuity_j9")
def _(fx):
    track = fx.track.withColumn("heading", (F.col("id") * 37 % 360).cast("double"))
    return J.map_match(track, segments(fx), 0.03, heading_weight=0.01, switch_penalty=0.005)


QUEEN = """w as (select a.id as i, b.id as j from fx_zones a join fx_zones b on a.id<>b.id
  and a.minx<=b.maxx and b.minx<=a.maxx and a.miny<=b.maxy and b.miny<=a.maxy)"""
ROOK = """w as (select a.id as i, b.id as j from fx_zones a join fx_zones b on a.id<>b.id
  and a.minx<=b.maxx and b.minx<=a.maxx and a.miny<=b.maxy and b.miny<=a.maxy
  and (a.minx=b.minx or a.miny=b.miny))"""


@query("contiguity_queen_j10", f"with {QUEEN} select i, j from w")
def _(fx):
    return J.contiguity(boxed(fx.zones), "queen")


@query("contiguity_rook_j10", f"with {ROOK} select i, j from w")
def _(fx):
    return J.contiguity(boxed(fx.zones), "rook")


ZONE_VALUES = """zv as (select z.id, z.minx, z.miny, z.maxx, z.maxy, count(p.id)+z.id%5 as v from fx_zones z left join
  fx_parcels p on p.minx>=z.minx and p.minx<z.maxx and p.miny>=z.miny and p.miny<z.maxy
  group by z.id, z.minx, z.miny, z.maxx, z.maxy)"""


def zone_values(fx):
    """Zones with the number of parcels that start in them (plus a small known offset)."""
    parcels = fx.parcels.select(
        (F.floor(F.col("minx") / 40) * 25 + F.floor(F.col("miny") / 40)).alias("zone"))
    counts = parcels.groupBy("zone").count()
    zones = boxed(fx.zones)
    return (zones.join(counts, zones.id == counts.zone, "left")
            .withColumn("v", F.coalesce("count", F.lit(0)) + F.col("id") % 5)
            .drop("zone", "count"))


@query("spatial_lag_j11", f"""
with {ZONE_VALUES}, {ROOK}
select z.id, cast(sum(n.v) as bigint) as lag_sum, round(avg(n.v),6) as lag_mean,
count(n.v) as n_neighbors, round(avg(n.v)/1600.0e0,9) as density
from zv z left join w on w.i=z.id left join zv n on n.id=w.j group by z.id""")
def _(fx):
    zones = zone_values(fx).withColumn("area", G.polygon_area(F.col("geom")))
    out = J.spatial_lag(zones, J.contiguity(zones, "rook"), "v", area="area")
    return out.select("id", "lag_sum", F.round("lag_mean", 6).alias("lag_mean"), "n_neighbors",
                      F.round("density", 9).alias("density"))
