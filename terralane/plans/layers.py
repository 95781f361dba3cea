"""Queries for filters, measures, merges and summaries."""

from pyspark.sql import functions as F

from terralane.functions import geometry as G
from terralane.operators import aggregates as A
from terralane.operators import measures as M
from terralane.plans.joins import boxed
from terralane.plans.registry import query
from terralane.session import spread

MERC_X = "radians({x})*6378137.0e0"
MERC_Y = "ln(tan(pi()/4+radians({y})/2))*6378137.0e0"


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


# paths of ten vertices and notched parcels, both derived row by row
PATHS = """pv as (select p_partkey as id, i, 116.0e0+((p_partkey*2741)%10007)/10007.0e0+i*0.002e0 as x,
  39.5e0+((p_partkey*1979)%10009)/10009.0e0+((p_partkey*31+i*i*7)%11)*0.0005e0 as y
  from part cross join (select unnest(generate_series(0,9)) as i))"""


def paths(fx):
    """Ten-vertex lines, one per part."""
    k = F.col("p_partkey")

    def vertex(i):
        x = F.lit(116.0) + ((k * 2741) % 10007) / 10007.0 + i * F.lit(0.002)
        y = F.lit(39.5) + ((k * 1979) % 10009) / 10009.0 + ((k * 31 + i * i * 7) % 11) * F.lit(0.0005)
        return G.xy(x, y)
    line = F.transform(F.sequence(F.lit(0), F.lit(9)), vertex)
    df = fx.part.select(k.alias("id"), F.col("p_brand").alias("brand"),
                        G.geometry("LineString", F.array(line)).alias("geom"))
    # a shuffle ends the expression: lambdas over an unfinished geometry build it again for every vertex
    return G.with_bounds(spread(df, "id"))


def notched(fx):
    """Parcels with the upper-left unit column cut down to height 2 (a concave ring)."""
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    ring = F.array(G.xy(x0, y0), G.xy(x1, y0), G.xy(x1, y1), G.xy(x0 + 1, y1), G.xy(x0 + 1, y0 + 2),
                   G.xy(x0, y0 + 2), G.xy(x0, y0))
    return fx.parcels.withColumn("geom", G.geometry("Polygon", F.array(ring)))


@query("select_by_attribute_p1", """
select id, v from fx_places where v>=0 and grp in (1,3,5,7) and v<9000""")
def _(fx):
    df = M.select_by_attribute(fx.places, "v", ">=", 0)
    df = M.select_by_attribute(df, "grp", "in", [1, 3, 5, 7])
    return M.select_by_attribute(df, "v", "<", 9000).select("id", "v")


@query("select_by_pattern_p1", "select id, name from fx_pois where name like 'poi_1%5' and kind<>2")
def _(fx):
    df = M.select_by_attribute(fx.pois, "name", "like", "poi_1%5")
    return M.select_by_attribute(df, "kind", "!=", 2).select("id", "name")


@query("bbox_filter_p3", """
select id from fx_places where x between 116.25 and 116.6 and y between 39.7 and 40.1""")
def _(fx):
    return M.bbox_filter(fx.places, (116.25, 39.7, 116.6, 40.1)).select("id")


@query("bbox_filter_features_p3", """
select id from fx_parcels where minx<=300 and maxx>=120 and miny<=250.5 and maxy>=90.25
and not (maxy-1e-9>90.25 and miny+2<90.25 and maxx>=120 and minx+1>300)""")
def _(fx):
    return M.bbox_filter(boxed(fx.parcels), (120, 90.25, 300, 250.5), exact=True).select("id")


@query("reproject_mercator_p5", f"""
select id, round({MERC_X.format(x='x')},3) as x, round({MERC_Y.format(y='y')},3) as y, 3857 as srid
from fx_places""")
def _(fx):
    out = M.reproject_layer(fx.places, 4326, 3857)
    return rounded(out, 3, "x", "y").select("id", "x", "y", "srid")


@query("reproject_features_p5", f"""
with {PATHS} select id, round(min({MERC_X.format(x='x')}),3) as minx, round(max({MERC_X.format(x='x')}),3) as maxx,
round(min({MERC_Y.format(y='y')}),3) as miny, round(max({MERC_Y.format(y='y')}),3) as maxy from pv group by id""")
def _(fx):
    out = M.reproject_layer(paths(fx), 4326, 3857)
    return rounded(out, 3, "minx", "maxx", "miny", "maxy").select("id", "minx", "maxx", "miny", "maxy")


# the transverse Mercator series written with plain numbers for zone 50 (central meridian 117)
@query("reproject_utm_p5", """
with a as (select id, radians(x-117.0e0) as lam, sin(radians(y)) as s, 0.0818191908426215e0 as e from fx_places),
b as (select *, sinh(atanh(s)-e*atanh(e*s)) as t from a),
k as (select id, atan2(t,cos(lam)) as xi, atanh(sin(lam)/sqrt(1+t*t)) as eta from b),
n as (select 1.0e0/298.257223563e0/(2-1.0e0/298.257223563e0) as n),
m as (select n, 6378137.0e0/(1+n)*(1+n*n/4+n*n*n*n/64)*0.9996e0 as r, n/2-2*n*n/3+5*n*n*n/16 as a1,
  13*n*n/48-3*n*n*n/5 as a2, 61*n*n*n/240 as a3 from n)
select id, 50 as zone, 32650 as srid,
round(500000+r*(eta+a1*cos(2*xi)*sinh(2*eta)+a2*cos(4*xi)*sinh(4*eta)+a3*cos(6*xi)*sinh(6*eta)),3) as x,
round(r*(xi+a1*sin(2*xi)*cosh(2*eta)+a2*sin(4*xi)*cosh(4*eta)+a3*sin(6*xi)*cosh(6*eta)),3) as y
from k cross join m""")
def _(fx):
    out = M.reproject_to_utm(fx.places)
    return rounded(out, 3, "x", "y").select("id", "zone", "srid", "x", "y")


def _wave(*terms):
    return "(" + "+".join(f"{w}*sin({a})" for w, a in terms) + ")*2.0e0/3.0e0"


GCJ = f"""o as (select id, x as lon, y as lat, x-105.0e0 as a, y-35.0e0 as b, radians(y) as rad from fx_places),
p as (select *, {_wave((20, '6*a*pi()'), (20, '2*a*pi()'))} as rip,
  1-0.00669342162296594323e0*sin(rad)*sin(rad) as mg from o),
q as (select *, -100+2*a+3*b+0.2e0*b*b+0.1e0*a*b+0.2e0*sqrt(abs(a))+rip
  +{_wave((20, 'b*pi()'), (40, 'b/3*pi()'))}+{_wave((160, 'b/12*pi()'), (320, 'b*pi()/30'))} as dy,
  300+a+2*b+0.1e0*a*a+0.1e0*a*b+0.1e0*sqrt(abs(a))+rip
  +{_wave((20, 'a*pi()'), (40, 'a/3*pi()'))}+{_wave((150, 'a/12*pi()'), (300, 'a/30*pi()'))} as dx from p),
g as (select id, lon+dx*180/(6378245.0e0/sqrt(mg)*cos(rad)*pi()) as gx,
  lat+dy*180/(6378245.0e0*(1-0.00669342162296594323e0)/(mg*sqrt(mg))*pi()) as gy from q)"""


@query("datum_gcj02_p6", f"with {GCJ} select id, round(gx,7) as x, round(gy,7) as y from g")
def _(fx):
    return rounded(M.convert_datum(fx.places, "wgs84", "gcj02"), 7, "x", "y").select("id", "x", "y")


@query("datum_bd09_p6", f"""
with {GCJ}, z as (select id, sqrt(gx*gx+gy*gy)+0.00002e0*sin(gy*pi()*3000/180) as r,
atan2(gy,gx)+0.000003e0*cos(gx*pi()*3000/180) as th from g)
select id, round(r*cos(th)+0.0065e0,7) as x, round(r*sin(th)+0.006e0,7) as y from z""")
def _(fx):
    return rounded(M.convert_datum(fx.places, "wgs84", "bd09"), 7, "x", "y").select("id", "x", "y")


@query("define_crs_p7", """
select 'places' as layer, id, 4326 as srid from fx_places union all
select 'cloud', id, 3857 from fx_cloud""")
def _(fx):
    places = M.define_crs(fx.places).select(F.lit("places").alias("layer"), "id", "srid")
    cloud = M.define_crs(fx.cloud).select(F.lit("cloud").alias("layer"), "id", "srid")
    return places.unionAll(cloud)


@query("measure_area_p8", f"""
select id, round(({MERC_X.format(x='maxx')}-{MERC_X.format(x='minx')})
*({MERC_Y.format(y='maxy')}-{MERC_Y.format(y='miny')})/1e6,4) as area_sqkm from fx_districts""")
def _(fx):
    out = M.measure_area(boxed(fx.districts), "sqkm", "area_sqkm")
    return rounded(out, 4, "area_sqkm").select("id", "area_sqkm")


@query("measure_area_concave_p8", """
select sum((maxx-minx)*(maxy-miny)-(maxy-miny-2)) as total, count(*) as feature_count from fx_parcels""")
def _(fx):
    return M.layer_total(M.measure_area(notched(fx), "sqm", srid=3857), "area")


@query("measure_length_p9", f"""
with {PATHS}, m as (select id, i, {MERC_X.format(x='x')} as x, {MERC_Y.format(y='y')} as y from pv),
s as (select id, sqrt(power(lead(x) over w-x,2)+power(lead(y) over w-y,2)) as d from m window w as (partition by id order by i))
select id, round(sum(d)/1609.344e0,6) as miles from s group by id""")
def _(fx):
    out = M.measure_length(paths(fx), "mile", "miles")
    return rounded(out, 6, "miles").select("id", "miles")


@query("centroids_p10", """
with a as (select id, kind, minx, miny, (maxx-minx)*(maxy-miny) as full_a, maxy-miny-2 as cut_a,
(minx+maxx)/2 as fx, (miny+maxy)/2 as fy, minx+0.5e0 as nx, (miny+2+maxy)/2 as ny from fx_parcels)
select id, kind, round((full_a*fx-cut_a*nx)/(full_a-cut_a),6) as x,
round((full_a*fy-cut_a*ny)/(full_a-cut_a),6) as y from a""")
def _(fx):
    return rounded(M.centroids(notched(fx)), 6, "x", "y").select("id", "kind", "x", "y")


@query("centroids_of_lines_p10", f"""
with {PATHS}, s as (select id, sqrt(power(lead(x) over w-x,2)+power(lead(y) over w-y,2)) as d,
(lead(x) over w+x)/2 as mx, (lead(y) over w+y)/2 as my from pv window w as (partition by id order by i))
select id, round(sum(d*mx)/sum(d),7) as x, round(sum(d*my)/sum(d),7) as y from s group by id""")
def _(fx):
    return rounded(M.centroids(paths(fx)), 7, "x", "y").select("id", "x", "y")


@query("simplify_layer_p11")
def _(fx):
    return M.simplify_layer(paths(fx), 0.001).select(
        "id", "vertices_before", "vertices_after",
        F.round(G.path_length(F.col("geom")), 9).alias("length"))


@query("buffer_points_p12", """
select id, round(0.5e0*64*sin(2*pi()/64)*power(degrees(500.0e0/6371000.0e0),2)/cos(radians(y)),10) as area,
round(x-degrees(500.0e0/6371000.0e0)/cos(radians(y)),9) as minx,
round(y+degrees(500.0e0/6371000.0e0),9) as maxy from fx_places""")
def _(fx):
    out = M.measure_area(M.buffer_points(fx.places, 500.0), "sqdeg")
    return out.select("id", F.round("area", 10).alias("area"), F.round("minx", 9).alias("minx"),
                      F.round("maxy", 9).alias("maxy"))


@query("buffer_points_mercator_p12", f"""
select id, round(0.5e0*64*sin(2*pi()/64)*4e6,2) as area, round(degrees((radians(x)*6378137.0e0+2000)/6378137.0e0),9) as maxx
from fx_places""")
def _(fx):
    out = M.measure_area(M.buffer_points(fx.places, 2, "kilometers", plane="3857"), "sqm")
    return out.select("id", F.round("area", 2).alias("area"), F.round("maxx", 9).alias("maxx"))


@query("merge_layers_o8", """
select 0 as layer, id, name, cast(null as double) as v from fx_pois union all
select 1, id, null, v from fx_facilities""")
def _(fx):
    return M.merge_layers(fx.pois.select("id", "name"), fx.facilities.select("id", "v"))


@query("summarize_a1", """
select grp, round(sum(v),2) as v_sum, min(x) as x_min, count(id) as id_count from fx_places group by grp""")
def _(fx):
    out = A.summarize(fx.places, "grp", {"v": "sum", "x": "min", "id": "count"})
    return out.withColumn("v_sum", F.round("v_sum", 2))


@query("profile_layer_a2", """
select count(*) as feature_count, min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy,
3857 as srid, count(*) as polygons, 'id,kind,minx,miny,maxx,maxy' as numeric_columns from fx_parcels""")
def _(fx):
    out = A.profile_layer(boxed(fx.parcels))
    return out.select("feature_count", "minx", "miny", "maxx", "maxy", "srid",
                      F.col("geometry_types")["Polygon"].alias("polygons"),
                      F.array_join("numeric_columns", ",").alias("numeric_columns"))


@query("profile_table_a3", """
select 'id' as "column", 'integer' as type, count(*) as row_count, 0::bigint as null_count, round(avg(id),4) as mean,
round(stddev_samp(id),4) as std, cast(min(id) as double) as min, cast(max(id) as double) as max from fx_pois union all
select 'name', 'text', count(*), 0::bigint, null, null, null, null from fx_pois union all
select 'kind', 'integer', count(*), 0, round(avg(kind),4), round(stddev_samp(kind),4), min(kind), max(kind) from fx_pois union all
select 'x', 'float', count(*), 0, round(avg(x),4), round(stddev_samp(x),4), min(x), max(x) from fx_pois union all
select 'y', 'float', count(*), 0, round(avg(y),4), round(stddev_samp(y),4), min(y), max(y) from fx_pois""")
def _(fx):
    out = A.profile_table(fx.pois)
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("raster_stats_a4", """
select band, min(v) as min, max(v) as max, round(avg(v),4) as mean, round(stddev_pop(v),4) as std,
round(quantile_cont(v,0.25),6) as p25, round(quantile_cont(v,0.5),6) as median,
round(quantile_cont(v,0.75),6) as p75, count(v) as valid_pixels, count(*)-count(v) as nodata_pixels
from (select band, case when (r*500+c)%97=0 then null else v end as v from fx_bands) group by band""")
def _(fx):
    holes = fx.bands.withColumn("v", F.when((F.col("r") * 500 + F.col("c")) % 97 != 0, F.col("v")))
    out = A.raster_stats(holes)
    return rounded(rounded(out, 4, "mean", "std"), 6, "p25", "median", "p75")




@query("classify_equal_a6", """
with b as (select min(v) as lo, max(v) as hi from fx_places),
c as (select id, (v>lo+(hi-lo)*1/5)::int+(v>lo+(hi-lo)*2/5)::int+(v>lo+(hi-lo)*3/5)::int+(v>lo+(hi-lo)*4/5)::int as class
from fx_places cross join b) select class, count(*) as count from c group by class""")
def _(fx):
    return A.class_counts(A.classify(fx.places, "v", 5, "equal"))


@query("classify_quantile_a6", """
with b as (select quantile_cont(v,0.2) as b1, quantile_cont(v,0.4) as b2, quantile_cont(v,0.6) as b3,
quantile_cont(v,0.8) as b4 from fx_places)
select id, (v>b1)::int+(v>b2)::int+(v>b3)::int+(v>b4)::int as class from fx_places cross join b""")
def _(fx):
    return A.classify(fx.places, "v", 5, "quantile").select("id", "class")


@query("classify_natural_a6")
def _(fx):
    return A.class_counts(A.classify(fx.places, "v", 4, "natural"))


@query("density_grid_a7", """
select cast(floor(x/0.05e0) as bigint) as cx, cast(floor(y/0.05e0) as bigint) as cy,
round(sum(v),2) as density, count(*) as n from fx_places group by 1,2""")
def _(fx):
    return A.density_grid(fx.places, 0.05, "v").withColumn("density", F.round("density", 2))


@query("height_stats_a9", """
with g as (select min(z) filter (where cls=2) as ground from fx_cloud)
select count(*) as n, min(z) as z_min, max(z) as z_max, round(avg(z),4) as z_mean, ground, round(stddev_pop(z),4) as z_std,
round(min(z)-ground,4) as rel_min, round(max(z)-ground,4) as rel_max, round(avg(z)-ground,4) as rel_mean,
round(quantile_cont(z,0.25)-ground,4) as p25, round(quantile_cont(z,0.5)-ground,4) as p50,
round(quantile_cont(z,0.75)-ground,4) as p75 from fx_cloud cross join g group by ground""")
def _(fx):
    return rounded(A.height_stats(fx.cloud), 4, "z_mean", "z_std", "rel_min", "rel_max", "rel_mean",
                   "p25", "p50", "p75")


@query("filter_classes_a10", "select id, cls from fx_cloud where cls in (2,4)")
def _(fx):
    return A.filter_classes(fx.cloud, ["ground", "vegetation_medium"]).select("id", "cls")


@query("ground_filter_a11", """
select id, z from fx_cloud where z < (select quantile_cont(z,0.15) from fx_cloud)""")
def _(fx):
    return A.ground_filter(fx.cloud).select("id", "z")


@query("ground_filter_tiled_a11", """
with q as (select floor(x/250) as tx, floor(y/250) as ty, quantile_cont(z,0.15) as lim from fx_cloud group by 1,2)
select id, z from fx_cloud c join q on floor(c.x/250)=q.tx and floor(c.y/250)=q.ty where z<lim""")
def _(fx):
    return A.ground_filter(fx.cloud, tile=250.0).select("id", "z")


@query("extent_a12", """
select min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy, (min(x)+max(x))/2 as center_x,
(min(y)+max(y))/2 as center_y, cast(floor(((min(x)+max(x))/2+180)/6)+1 as integer) as utm_zone, 4326 as epsg from fx_places""")
def _(fx):
    return A.extent(fx.places)


@query("network_stats_a13", """
with e as (select src as n from fx_edges union all select dst from fx_edges), d as (select n, count(*) as k from e group by n)
select count(*) as nodes, cast(sum(k)/2 as bigint) as edges, round(avg(k),6) as mean_degree from d""")
def _(fx):
    return rounded(A.network_stats(fx.edges), 6, "mean_degree")


@query("profile_cells_a14", """
select count(distinct band) as bands, cast(max(r)-min(r)+1 as bigint) as rows, cast(max(c)-min(c)+1 as bigint) as cols,
count(v) as valid, count(*)-count(v) as nodata, 30.0e0 as res_x, 30.0e0 as res_y, 32650 as srid,
500000.0e0+min(c)*30 as minx, 500000.0e0+(max(c)+1)*30 as maxx, 4400000.0e0-(max(r)+1)*30 as miny,
4400000.0e0-min(r)*30 as maxy, 'double' as dtype from fx_bands""")
def _(fx):
    return A.profile_cells(fx.bands, {"x0": 500000, "y0": 4400000, "dx": 30, "dy": -30, "srid": 32650})
