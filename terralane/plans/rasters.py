"""Queries for raster, index and zonal operators."""

from pyspark.sql import functions as F

from terralane.operators import raster as R
from terralane.plans.joins import boxed
from terralane.plans.layers import rounded
from terralane.plans.registry import query

# lon/lat grid over the working area for rasters of 500 columns
GRID = {"x0": 116.0, "y0": 40.5, "dx": 0.002, "dy": -0.002, "srid": 4326}
CENTER = "116.0e0+(c+0.5e0)*0.002e0 as x, 40.5e0+(r+0.5e0)*-0.002e0 as y"


def holes(cells):
    """Make every 97th cell nodata."""
    return cells.withColumn("v", F.when((F.col("r") * 500 + F.col("c")) % 97 != 0, F.col("v")))


HOLES = "case when (r*500+c)%97=0 then null else v end"


def band(fx, n):
    return fx.bands.filter(F.col("band") == n)


def rows_of(fx):
    """Number of raster rows of the data folder."""
    return fx.dem.agg(F.max("r")).first()[0] + 1


@query("clip_cells_r1", f"""
with k as (select *, {CENTER} from fx_dem)
select r, c, v from k where exists (select 1 from fx_districts d where d.grp=2
and k.x>=d.minx and k.x<=d.maxx and k.y>=d.miny and k.y<=d.maxy)""")
def _(fx):
    return R.clip_cells(fx.dem, boxed(fx.districts.filter("grp = 2")), GRID)


@query("clip_cells_all_touched_r1", f"""
with k as (select *, {CENTER} from fx_dem), b as (select 116.301e0+n_nationkey*0.02e0 as minx,
116.3075e0+n_nationkey*0.02e0 as maxx, 40.471e0 as miny, 40.4895e0 as maxy from nation)
select r, c, v from k where exists (select 1 from b where k.x-0.001e0<=b.maxx and b.minx<=k.x+0.001e0
and k.y-0.001e0<=b.maxy and b.miny<=k.y+0.001e0)""")
def _(fx):
    key = F.col("n_nationkey")
    boxes = fx.nation.select((key * 0.02 + 116.301).alias("minx"), (key * 0.02 + 116.3075).alias("maxx"),
                             F.lit(40.471).alias("miny"), F.lit(40.4895).alias("maxy"))
    return R.clip_cells(fx.dem, boxed(boxes), GRID, all_touched=True)


@query("mask_cells_r2", f"""
with k as (select *, {CENTER} from fx_dem)
select r, c, case when exists (select 1 from fx_districts d where d.grp=2
and k.x>=d.minx and k.x<=d.maxx and k.y>=d.miny and k.y<=d.maxy) then -1.0e0 else v end as v from k""")
def _(fx):
    return R.mask_cells(fx.dem, boxed(fx.districts.filter("grp = 2")), GRID, invert=True, nodata=-1.0)


@query("zonal_stats_a5", f"""
with k as (select *, {CENTER} from fx_dem)
select d.id, round(avg(k.v),4) as mean, round(sum(k.v),2) as sum, count(k.v) as count, min(k.v) as min,
max(k.v) as max, round(stddev_pop(k.v),4) as std from fx_districts d left join k
on k.x>=d.minx and k.x<=d.maxx and k.y>=d.miny and k.y<=d.maxy group by d.id""")
def _(fx):
    out = R.zonal_stats(fx.dem, boxed(fx.districts), GRID)
    return rounded(rounded(out, 4, "mean", "std"), 2, "sum")


@query("mosaic_r3", f"""
with a as (select r, c, case when (r*500+c)%3=0 then null else v end as v from fx_dem),
b as (select r, c, {HOLES}+1000 as v from fx_dem)
select r, c, coalesce(a.v, b.v) as v_first, coalesce(b.v, a.v) as v_last,
least(a.v,b.v) as v_min, greatest(a.v,b.v) as v_max from a join b using (r, c)""")
def _(fx):
    a = fx.dem.withColumn("v", F.when((F.col("r") * 500 + F.col("c")) % 3 != 0, F.col("v")))
    b = holes(fx.dem).withColumn("v", F.col("v") + 1000)
    out = None
    for m in ("first", "last", "min", "max"):
        part = R.mosaic(a, b, method=m).withColumnRenamed("v", "v_" + m)
        out = part if out is None else out.join(part, ["r", "c"])
    return out


@query("resample_nearest_r4", """
with n as (select max(r)+1 as rows from fx_dem), g as (select cast(i/1000 as int) as r, cast(i%1000 as int) as c from
(select unnest(generate_series(0, (select rows*2*1000-1 from n))) as i)),
h as (select i//1000 as r, i%1000 as c from (select unnest(generate_series(0, (select rows*2*1000-1 from n))) as i))
select h.r, h.c, d.v from h left join fx_dem d on d.r=h.r//2 and d.c=h.c//2""")
def _(fx):
    return R.resample(fx.dem, {**GRID, "rows": rows_of(fx), "cols": 500}, 2)


@query("resample_bilinear_r4", """
with n as (select max(r)+1 as rows from fx_dem),
h as (select i//250 as r, i%250 as c from (select unnest(generate_series(0, (select (rows//2)*250-1 from n))) as i))
select h.r, h.c, round((a.v+b.v+p.v+q.v)/4,6) as v from h
left join fx_dem a on a.r=h.r*2 and a.c=h.c*2 left join fx_dem b on b.r=h.r*2 and b.c=h.c*2+1
left join fx_dem p on p.r=h.r*2+1 and p.c=h.c*2 left join fx_dem q on q.r=h.r*2+1 and q.c=h.c*2+1""")
def _(fx):
    rows = rows_of(fx)
    out = R.resample(fx.dem, {**GRID, "rows": rows, "cols": 500}, 0.5, "bilinear")
    return out.withColumn("v", F.round("v", 6))


@query("resample_cubic_r4", """
with n as (select max(r)+1 as rows from fx_dem),
h as (select i//250 as r, i%250 as c from (select unnest(generate_series(0, (select (rows//2)*250-1 from n))) as i)),
k as (select * from (values (-1,-0.0625e0),(0,0.5625e0),(1,0.5625e0),(2,-0.0625e0)) t(o,w)),
s as (select h.r, h.c, a.w*b.w as w, greatest(0, least(n.rows-1, h.r*2+a.o)) as sr, greatest(0, least(499, h.c*2+b.o)) as sc
from h cross join k a cross join k b cross join n)
select s.r, s.c, round(sum(s.w*d.v)/sum(s.w),6) as v from s join fx_dem d on d.r=s.sr and d.c=s.sc group by s.r, s.c""")
def _(fx):
    rows = rows_of(fx)
    out = R.resample(fx.dem, {**GRID, "rows": rows, "cols": 500}, 0.5, "cubic")
    return out.withColumn("v", F.round("v", 6))


@query("resample_average_r4", """
select cast(floor(r*0.25e0) as bigint) as r, cast(floor(c*0.25e0) as bigint) as c, round(avg(v),6) as v
from fx_dem group by 1, 2""")
def _(fx):
    out = R.resample(fx.dem, {**GRID, "rows": rows_of(fx), "cols": 500}, 0.25, "average")
    return out.withColumn("v", F.round("v", 6))


@query("warp_r5", """
with n as (select max(r)+1 as rows from fx_dem),
h as (select i//400 as r, i%400 as c from (select unnest(generate_series(0, (select rows*400-1 from n))) as i)),
p as (select r, c, degrees((12913060.0e0+(c+0.5e0)*270)/6378137.0e0) as x,
 degrees(2*atan(exp((4938000.0e0-(r+0.5e0)*270)/6378137.0e0))-pi()/2) as y from h),
f as (select r, c, (x-116.0e0)/0.002e0-0.5e0 as fc, (y-40.5e0)/-0.002e0-0.5e0 as fr from p)
select f.r, f.c, d.v from f left join fx_dem d on d.r=floor(f.fr+0.5e0) and d.c=floor(f.fc+0.5e0)""")
def _(fx):
    rows = rows_of(fx)
    target = {"x0": 12913060.0, "y0": 4938000.0, "dx": 270.0, "dy": -270.0, "rows": rows,
              "cols": 400, "srid": 3857}
    return R.warp(fx.dem, {**GRID, "rows": rows, "cols": 500}, target)


@query("band_math_r6", f"""
with w as (select r, c, coalesce(max(case when band=8 then {HOLES} end),0) as n,
coalesce(max(case when band=4 then {HOLES} end),0) as b4 from fx_bands group by r, c)
select r, c, round(case when n-b4=0 then 0 else (sqrt(n)+2*b4)/(n-b4) end,6) as v from w""")
def _(fx):
    out = R.band_math(holes(fx.bands), "(sqrt(nir) + 2*b4) / (nir - b4)", {"nir": 8})
    return rounded(out, 6, "v")


def wide(*bands):
    parts = ", ".join(f"max(v) filter (where band={b}) as b{b}" for b in bands)
    return f"w as (select r, c, {parts} from fx_scene group by r, c)"


@query("sensor_index_r7", f"""
with {wide(3, 4, 5, 6, 8)}, i as (select 'ndvi_sentinel2' as name, (b8-b4)/(b8+b4) as v from w
union all select 'ndwi_landsat8', (b3-b5)/(b3+b5) from w union all select 'ndbi_landsat9', (b6-b5)/(b6+b5) from w)
select name, round(min(v),4) as min, round(max(v),4) as max, round(avg(v),4) as mean,
round(stddev_pop(v),4) as std, count(v) as valid_pixels from i group by name""")
def _(fx):
    out = None
    for index, sensor in (("ndvi", "sentinel2"), ("ndwi", "landsat8"), ("ndbi", "landsat9")):
        part = R.index_summary(R.sensor_index(fx.scene, index, sensor)).withColumn(
            "name", F.lit(f"{index}_{sensor}"))
        out = part if out is None else out.unionByName(part)
    return out


@query("ndvi_r8", f"""
with w as (select r, c, max(case when band=8 then {HOLES} end) as n, max(case when band=4 then {HOLES} end) as b4
from fx_bands group by r, c) select r, c, round((n-b4)/nullif(n+b4,0),6) as v from w""")
def _(fx):
    return rounded(R.ndvi(holes(fx.bands)), 6, "v")


@query("ndwi_counts_r8", f"""
with {wide(3, 8)} select count((b3-b8)/nullif(b3+b8,0)) as valid_pixels,
count(*) filter (where (b3-b8)/nullif(b3+b8,0)>0) as water_pixels from w""")
def _(fx):
    return R.ndwi_counts(R.ndwi(fx.scene))


@query("spectral_indices_r9", f"""
with {wide(2, 3, 4, 5, 8, 11, 12)}, i as (
select r, c, unnest(['EVI','EVI2','SAVI','MSAVI','NDBI','NDSI','MNDWI','LSWI','NDMI','NDRE','GNDVI','GCI','NBR']) as name,
unnest([2.5e0*(b8-b4)/nullif(b8+6*b4-7.5e0*b2+1,0), 2.5e0*(b8-b4)/(b8+2.4e0*b4+1), 1.5e0*(b8-b4)/(b8+b4+0.5e0),
(2*b8+1-sqrt(greatest(power(2*b8+1,2)-8*(b8-b4),0)))/2, (b11-b8)/(b11+b8), (b3-b11)/(b3+b11), (b3-b11)/(b3+b11),
(b8-b11)/(b8+b11), (b8-b11)/(b8+b11), (b8-b5)/(b8+b5), (b8-b3)/(b8+b3), b8/b3-1, (b8-b12)/(b8+b12)]) as v from w)
select name, count(*) as n, round(avg(coalesce(v,0)),4) as mean from i group by name""")
def _(fx):
    names = [n for n in R.INDEX_FORMULAS if n not in ("NDVI", "NDWI")]
    wide_table = R.spectral_indices(fx.scene, names)
    sums = wide_table.agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("mean")) for n in names]))
    return sums.select("n", pairs.alias("p")).select("p.name", "n", F.round("p.mean", 4).alias("mean"))


@query("spectral_index_savi_r9", f"""
with {wide(4, 8)} select r, c, round(1.5e0*(b8-b4)/(b8+b4+0.5e0),6) as v from w""")
def _(fx):
    return rounded(R.spectral_index(fx.scene, "SAVI"), 6, "v")


@query("all_indices_r10", f"""
with {wide(3, 4, 8, 11, 12)} select r, c, round((b8-b4)/(b8+b4),6) as "NDVI", round((b3-b8)/(b3+b8),6) as "NDWI",
round((b3-b11)/(b3+b11),6) as "MNDWI", round((b11-b8)/(b11+b8),6) as "NDBI", round((b8-b12)/(b8+b12),6) as "NBR" from w""")
def _(fx):
    return rounded(R.all_indices(fx.scene), 6, "NDVI", "NDWI", "MNDWI", "NDBI", "NBR")


@query("change_detection_r11", """
with d as (select a.r, a.c, (b.v-a.v)/(a.v+1e-10) as change from fx_bands a join fx_bands b
on a.r=b.r and a.c=b.c and a.band=4 and b.band=8)
select round(min(change),6) as change_min, round(max(change),6) as change_max, round(avg(change),6) as change_mean,
count(*) filter (where change>0.1) as increased_pixels, count(*) filter (where change<-0.1) as decreased_pixels,
count(*) filter (where change between -0.1 and 0.1) as unchanged_pixels, count(*) as total_pixels,
round(count(*) filter (where abs(change)>0.1)/count(*),6) as change_ratio from d""")
def _(fx):
    out = R.change_summary(R.change_detection(band(fx, 4), band(fx, 8), "ratio"))
    return rounded(out, 6, "change_min", "change_max", "change_mean", "change_ratio")


@query("classify_threshold_r12", """
with m as (select min(v) as lo, max(v) as hi from fx_bands where band=4)
select cast(least(floor((v-lo)/((hi-lo)/5)),4) as bigint) as class, count(*) as n
from fx_bands cross join m where band=4 group by 1""")
def _(fx):
    return R.classify_cells(fx.bands, "threshold").groupBy("class").agg(F.count("*").alias("n"))


@query("classify_kmeans_r12")
def _(fx):
    return R.classify_cells(fx.bands, "kmeans", 4).groupBy("class").agg(F.count("*").alias("n"))


@query("composite_r13", f"""
with {wide(2, 3, 4)}, q as (select quantile_cont(b4,0.02) as r0, quantile_cont(b4,0.98) as r1,
quantile_cont(b3,0.02) as g0, quantile_cont(b3,0.98) as g1, quantile_cont(b2,0.02) as u0, quantile_cont(b2,0.98) as u1 from w)
select r, c, cast(floor(greatest(0,least(255,(b4-r0)/(r1-r0+1e-10)*255))) as bigint) as red,
cast(floor(greatest(0,least(255,(b3-g0)/(g1-g0+1e-10)*255))) as bigint) as green,
cast(floor(greatest(0,least(255,(b2-u0)/(u1-u0+1e-10)*255))) as bigint) as blue from w cross join q""")
def _(fx):
    return R.composite(fx.scene, "false_color")


@query("cloud_mask_r14", """
with m as (select avg(v) as m from fx_bands where band=4), k as (select (v/(m+1e-10)>1.2)::int as k from fx_bands cross join m where band=4)
select cast(sum(k) as bigint) as cloud_pixels, count(*) as total_pixels, round(avg(k),6) as cloud_ratio from k""")
def _(fx):
    return rounded(R.cloud_summary(R.cloud_mask(fx.bands, 4, 1.2)), 6, "cloud_ratio")


@query("reclassify_r15", """
select r, c, case when v>150 and v<=1e9 then 4.0e0 when v>140 and v<=200 then 3.0e0 when v>110 and v<=140 then 2.0e0
when v>0 and v<=105 then 1.0e0 else -9999.0e0 end as v from fx_dem""")
def _(fx):
    return R.reclassify(fx.dem, [(0, 105, 1), (110, 140, 2), (140, 200, 3), (150, 1e9, 4)])


@query("reclassify_long_table_r15", """
select r, c, case when v>=0 and v<100000 then floor(v/10)*1.0e0 else null end as v from fx_dem""")
def _(fx):
    rules = [(10 * i, 10 * i + 10, i) for i in range(10_000)]
    return R.reclassify(fx.dem, rules, closed="left", nodata=None)


@query("fill_nodata_r16", """
with k as (select r, c, case when (r*500+c)%7<3 and r%3<>1 then null else v end as v from fx_dem),
p as (select a.r, a.c, b.v, row_number() over (partition by a.r, a.c order by
 (a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c), b.r, b.c) as rn from k a join k b
 on a.v is null and b.v is not null and b.r between a.r-2 and a.r+2 and b.c between a.c-2 and a.c+2
 and (a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c)<=4)
select k.r, k.c, coalesce(k.v, p.v) as v from k left join p on p.r=k.r and p.c=k.c and p.rn=1""")
def _(fx):
    gap = ((F.col("r") * 500 + F.col("c")) % 7 < 3) & (F.col("r") % 3 != 1)
    return R.fill_nodata(fx.dem.withColumn("v", F.when(~gap, F.col("v"))), 2.0)


@query("weighted_overlay_t11", """
with a as (select r, c, v, (v-min(v) over ())/(max(v) over ()-min(v) over ()) as n from fx_dem),
b as (select r, c, (v-min(v) over ())/(max(v) over ()-min(v) over ()) as n from fx_bands where band=4)
select a.r, a.c, round(0.75e0*a.n+0.25e0*b.n,6) as v from a join b on a.r=b.r and a.c=b.c""")
def _(fx):
    out = R.weighted_overlay({"height": fx.dem, "red": band(fx, 4), "flat": fx.dem.withColumn("v", F.lit(7.0))},
                             {"height": 3.0, "red": 1.0, "flat": 0.0})
    return rounded(out, 6, "v")


@query("ndvi_change_by_district", f"""
with {wide(3, 4, 5, 8)}, d as (select r, c, (b8-b4)/(b8+b4) as before, (b5-b3)/(b5+b3) as after, {CENTER} from w),
k as (select *, after-before as change from d)
select z.id, round(avg(k.change),6) as mean_change, count(k.change) as count,
count(*) filter (where k.change>0.05) as increased, count(*) filter (where k.change<-0.05) as decreased
from fx_districts z left join k on k.x>=z.minx and k.x<=z.maxx and k.y>=z.miny and k.y<=z.maxy group by z.id""")
def _(fx):
    """NDVI of two band pairs, change per cell, mean change and class counts per district."""
    changes = R.change_detection(R.ndvi(fx.scene, 8, 4), R.ndvi(fx.scene, 5, 3), threshold=0.05)
    zones = boxed(fx.districts)
    means = R.zonal_stats(changes.withColumnRenamed("change", "v"), zones, GRID, stats=("mean", "count"))
    out = means.withColumnRenamed("mean", "mean_change")
    for kind in ("increased", "decreased"):
        part = changes.filter(F.col("kind") == kind).withColumnRenamed("change", "v")
        n = R.zonal_stats(part, zones, GRID, stats=("count",)).withColumnRenamed("count", kind)
        out = out.join(n, "id")
    return rounded(out, 6, "mean_change")
