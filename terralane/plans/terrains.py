"""Queries for terrain and hydrology operators."""

import datetime as dt

from pyspark.sql import functions as F

from terralane.functions import geometry as G
from terralane.operators import hydrology as H
from terralane.operators import terrain as T
from terralane.plans.joins import boxed
from terralane.plans.layers import rounded
from terralane.plans.registry import query

# central differences of the elevation table, one-sided at the raster edge
GRAD = """g as (select r, c, v,
 (coalesce(lead(v) over x, v)-coalesce(lag(v) over x, v))/((case when lead(v) over x is null then 0 else 1 end
  +case when lag(v) over x is null then 0 else 1 end)*30.0e0) as gx,
 (coalesce(lead(v) over y, v)-coalesce(lag(v) over y, v))/((case when lead(v) over y is null then 0 else 1 end
  +case when lag(v) over y is null then 0 else 1 end)*30.0e0) as gy
 from fx_dem window x as (partition by r order by c), y as (partition by c order by r))"""


@query("slope_r18", f"with {GRAD} select r, c, round(degrees(atan(sqrt(gx*gx+gy*gy))),6) as slope from g")
def _(fx):
    return rounded(T.slope(fx.dem, 30.0), 6, "slope")


@query("slope_percent_r18", f"with {GRAD} select r, c, round(sqrt(4*gx*gx+4*gy*gy)*100,6) as slope from g")
def _(fx):
    return rounded(T.slope(fx.dem, 30.0, z=2.0, unit="percent"), 6, "slope")


@query("aspect_r19", f"""
with {GRAD}, a as (select r, c, degrees(atan2(gx, -gy)) as a from g)
select r, c, round(case when a<0 then a+360 else a end,6) as aspect from a""")
def _(fx):
    return rounded(T.aspect(fx.dem, 30.0), 6, "aspect")


def lit(az, alt):
    return (f"(gx*-sin(radians({az}))*cos(radians({alt}))+gy*cos(radians({az}))*cos(radians({alt}))"
            f"+sin(radians({alt})))/sqrt(gx*gx+gy*gy+1)")


@query("hillshade_r20", f"with {GRAD} select r, c, round(greatest(0.0e0,{lit(315, 45)})*255,4) as hillshade from g")
def _(fx):
    return rounded(T.hillshade(fx.dem, 30.0), 4, "hillshade")


@query("terrain_shadow_r21")
def _(fx):
    out = T.terrain_shadow(fx.dem, dt.datetime(2024, 12, 21, 8, 30), 39.9, 116.4, res=2.0)
    return rounded(out, 6, "shadow_ratio", "sun_azimuth", "sun_elevation")


@query("viewshed_r22", """
with o as (select v+1.7e0 as z from fx_dem where r=1 and c=250),
a as (select r, c, atan2(v-z, greatest(sqrt((r-1)*(r-1)+(c-250)*(c-250)),case when r=1 and c=250 then 1 else 0 end)*30) as a
from fx_dem cross join o)
select r, c, case when a>0 or (r=1 and c=250) then 1 else 0 end as visible from a""")
def _(fx):
    return T.viewshed(fx.dem, 1, 250, 1.7, 0.0, 30.0)


@query("viewshed_line_of_sight_r22")
def _(fx):
    return T.viewshed_summary(T.viewshed(fx.dem, 1, 250, 1.7, 0.0, 30.0, line_of_sight=True))


@query("cut_fill_r23", """
with d as (select v-(100+2*r+0.5e0*c+((r*500+c)*11)%17) as d from fx_dem)
select round(-coalesce(sum(d) filter (where d<0),0)*900,2) as fill_volume, round(-coalesce(sum(d) filter (where d>0),0)*900,2) as cut_volume,
round(-sum(d)*900,2) as net_volume, count(*) filter (where d<0) as fill_pixels, count(*) filter (where d>0) as cut_pixels from d""")
def _(fx):
    k = F.col("r") * 500 + F.col("c")
    after = fx.dem.withColumn("v", F.lit(100.0) + 2 * F.col("r") + F.col("c") * 0.5 + (k * 11) % 17)
    return rounded(T.cut_fill(fx.dem, after, 900.0), 2, "fill_volume", "cut_volume", "net_volume")


@query("volume_r24", """
select round(sum(v-200) filter (where v>200)*900,2) as total_volume, count(*) filter (where v>200)*900.0e0 as surface_area,
max(v)-200 as max_height from fx_dem""")
def _(fx):
    return rounded(T.volume(fx.dem, 200.0, 900.0), 2, "total_volume")


@query("elevation_profile_r25", """
with s as (select i, i*(sqrt(480.0e0*480+26*26)/999) as distance, 10.5e0+i*(480.0e0/999) as x, -1.5e0-i*(26.0e0/999) as y
from (select unnest(generate_series(0,999)) as i))
select i, round(distance,6) as distance, round(x,6) as x, round(y,6) as y, d.v as elevation from s
left join fx_dem d on d.c=floor(s.x) and d.r=floor(s.y/-1)""")
def _(fx):
    grid = {"x0": 0, "y0": 0, "dx": 1, "dy": -1}
    out = T.elevation_profile(fx.dem, grid, [(10.5, -1.5), (490.5, -27.5)], 1000)
    return rounded(out, 6, "distance", "x", "y")


@query("roughness_r26", """
with n as (select max(r) as mr, max(c) as mc from fx_dem),
o as (select * from (values (-1),(0),(1)) t(d)),
s as (select k.r, k.c, b.v from fx_dem k cross join o i cross join o j cross join n
join fx_dem b on b.r=least(n.mr,greatest(0,k.r+i.d)) and b.c=least(n.mc,greatest(0,k.c+j.d)))
select r, c, round(stddev_pop(v),6) as roughness from s group by r, c""")
def _(fx):
    return rounded(T.roughness(fx.dem), 6, "roughness")


def grad2(src, out, axis, res):
    """Difference of column ``src`` along an axis as a window expression."""
    w = "x" if axis == "c" else "y"
    return (f"(coalesce(lead({src}) over {w},{src})-coalesce(lag({src}) over {w},{src}))/"
            f"((case when lead({src}) over {w} is null then 0 else 1 end+case when lag({src}) over {w} is null then 0 else 1 end)*({res})) as {out}")


WIN = "window x as (partition by r order by c), y as (partition by c order by r)"


@query("curvature_r27", f"""
with a as (select r, c, {grad2('v', 'gx', 'c', '30.0e0')}, {grad2('v', 'gy', 'r', '-30.0e0')} from fx_dem {WIN}),
b as (select r, c, gx, gy, {grad2('gy', 'gyy', 'r', '-30.0e0')}, {grad2('gx', 'gxx', 'c', '30.0e0')},
{grad2('gx', 'gxy', 'r', '-30.0e0')} from a {WIN})
select r, c, round((gx*gx*gyy-2*gx*gy*gxy+gy*gy*gxx)/power(gx*gx+gy*gy+1e-10,1.5),6) as curvature from b""")
def _(fx):
    return rounded(T.curvature(fx.dem, 30.0), 6, "curvature")


DIRECTION = """n as (select max(r) as mr, max(c) as mc from fx_dem),
o as (select * from (values (1,0,1,1),(1,1,2,2),(0,1,4,3),(-1,1,8,4),(-1,0,16,5),(-1,-1,32,6),(0,-1,64,7),(1,-1,128,8)) t(dr,dc,code,ord)),
s as (select k.r, k.c, o.code, o.ord, (k.v-b.v)/(case when dr<>0 and dc<>0 then sqrt(2.0e0) else 1.0e0 end*30) as drop_
from fx_dem k cross join o cross join n join fx_dem b on b.r=k.r+o.dr and b.c=k.c+o.dc
where k.r between 1 and n.mr-1 and k.c between 1 and n.mc-1),
p as (select r, c, code, row_number() over (partition by r, c order by drop_ desc, ord) as rn from s where drop_>0),
dir as (select k.r, k.c, coalesce(p.code,0) as dir from fx_dem k left join p on p.r=k.r and p.c=k.c and p.rn=1)"""


@query("flow_direction_r28", f"with {DIRECTION} select r, c, dir from dir")
def _(fx):
    return T.flow_direction(fx.dem, 30.0)


# paths from every cell downstream, then a count of the visits
PATHS = f"""{DIRECTION}, t as materialized (select d.r, d.c, d.r+o.dr as nr, d.c+o.dc as nc from dir d left join o on o.code=d.dir),
walk as (select r as sr, c as sc, r, c from t union all
select w.sr, w.sc, t.nr, t.nc from walk w join t on t.r=w.r and t.c=w.c and t.nr is not null)"""


@query("flow_accumulation_r29", f"with recursive {PATHS} select r, c, count(*) as acc from walk group by r, c")
def _(fx):
    return H.flow_accumulation(T.flow_direction(fx.dem, 30.0))


@query("watershed_r30", f"with recursive {PATHS} select sr as r, sc as c from walk where r=1 and c=101")
def _(fx):
    return H.watershed(T.flow_direction(fx.dem, 30.0), 1, 101)


@query("fill_depressions_r31", """
with n as (select max(r) as mr, max(c) as mc from fx_dem), o as (select * from (values (0,0),(1,0),(-1,0),(0,1),(0,-1)) t(i,j)),
t as (select k.r, k.c, max(b.v) as v from fx_dem k cross join o cross join n
join fx_dem b on b.r=least(n.mr,greatest(0,k.r+o.i)) and b.c=least(n.mc,greatest(0,k.c+o.j)) group by k.r, k.c),
f as (select k.r, k.c, min(b.v) as v from t k cross join o cross join n
join t b on b.r=least(n.mr,greatest(0,k.r+o.i)) and b.c=least(n.mc,greatest(0,k.c+o.j)) group by k.r, k.c)
select d.r, d.c, f.v as filled, f.v-d.v as raised from fx_dem d join f on f.r=d.r and f.c=d.c""")
def _(fx):
    return T.fill_depressions(fx.dem).select("r", "c", "filled", (F.col("filled") - F.col("v")).alias("raised"))


@query("contour_r17", """
with q as (select a.r, a.c, a.v, b.v as e, d.v as s, f.v as se from fx_dem a join fx_dem b on b.r=a.r and b.c=a.c+1
join fx_dem d on d.r=a.r+1 and d.c=a.c join fx_dem f on f.r=a.r+1 and f.c=a.c+1),
l as (select *, 10.0e0*unnest(generate_series(cast(floor(least(v,e,s,se)/10) as bigint)+1, cast(floor(greatest(v,e,s,se)/10) as bigint))) as lv from q),
x as (select *, case when (v>=lv)<>(e>=lv) then (lv-v)/(e-v) end as t, case when (e>=lv)<>(se>=lv) then (lv-e)/(se-e) end as g,
 case when (s>=lv)<>(se>=lv) then (lv-s)/(se-s) end as b, case when (v>=lv)<>(s>=lv) then (lv-v)/(s-v) end as w from l where lv>=120),
y as (select lv, t is not null and g is not null and b is not null and w is not null as saddle,
 (((v+e+s+se)/4>=lv)=(v>=lv)) as main, t, g, b, w from x),
z as (select lv, case
 when saddle and main then sqrt(power(1-t,2)+g*g)+sqrt(b*b+power(1-w,2))
 when saddle then sqrt(t*t+w*w)+sqrt(power(1-g,2)+power(1-b,2))
 when t is not null and g is not null then sqrt(power(1-t,2)+g*g)
 when t is not null and b is not null then sqrt(power(t-b,2)+1)
 when t is not null then sqrt(t*t+w*w)
 when g is not null and b is not null then sqrt(power(1-b,2)+power(1-g,2))
 when g is not null then sqrt(1+power(g-w,2))
 else sqrt(b*b+power(1-w,2)) end as len, case when saddle then 2 else 1 end as n from y)
select lv as level, cast(sum(n) as bigint) as segments, round(sum(len),4) as length from z group by lv""")
def _(fx):
    seg = T.contour_segments(fx.dem, 10.0, min_z=120.0)
    length = G.euclidean(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return seg.groupBy("level").agg(F.count("*").alias("segments"), F.round(F.sum(length), 4).alias("length"))


@query("cast_shadows_r32", """
with t as (select * from (values (timestamp '2024-06-21 09:30:00'),(timestamp '2024-12-21 14:00:00')) t(ts)),
a as (select id, ts, minx, miny, (kind-1)*3.0e0 as h, hour(ts)+minute(ts)/60.0e0 as hr, dayofyear(ts) as d from fx_parcels cross join t),
b as (select *, greatest(0, greatest(0, 90-abs(hr-12)*10)+15*sin(2*pi()*(d-81)/365)) as el, (90+(hr-6)*15)%360 as az from a where h>0)
select id, ts::varchar as time, round(el,6) as sun_elevation, round(az,6) as sun_azimuth,
round(minx+h/tan(radians(greatest(el,1)))*sin(radians(az)),6) as minx,
round(miny+h/tan(radians(greatest(el,1)))*cos(radians(az)),6) as miny from b""")
def _(fx):
    buildings = boxed(fx.parcels).withColumn("height", (F.col("kind") - 1) * 3.0)
    out = T.cast_shadows(buildings, ["2024-06-21 09:30:00", "2024-12-21 14:00:00"])
    out = rounded(out, 6, "sun_elevation", "sun_azimuth", "minx", "miny")
    return out.select("id", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"),
                      "sun_elevation", "sun_azimuth", "minx", "miny")


SUN = """m as (select id, x, y, d.day, h.h, epoch(d.day)+h.h*3600.0e0 as s from fx_places
 cross join (values (timestamp '2024-06-21'),(timestamp '2024-12-21')) d(day) cross join (select unnest(generate_series(0,23)) as h) h),
a as (select id, x, y, day, s/86400.0e0-10957.5e0 as n from m), b as (select *, n/36525.0e0 as t from a),
c as (select *, radians((357.52911e0+35999.0503e0*t-0.0001537e0*t*t)%360) as g, (280.46646e0+36000.76983e0*t+0.0003032e0*t*t)%360 as l0,
 radians(23.439291e0-0.013004e0*t-0.00000016e0*t*t+0.000000504e0*t*t*t) as eps from b),
d as (select *, radians(l0+(1.9146e0-0.004817e0*t-0.000014e0*t*t)*sin(g)+(0.019993e0-0.000101e0*t)*sin(2*g)+0.00029e0*sin(3*g)) as lam from c),
e as (select *, asin(sin(eps)*sin(lam)) as dec, atan2(cos(eps)*sin(lam),cos(lam)) as ra,
 (280.46061837e0+360.98564736629e0*n+0.000387933e0*t*t-t*t*t/38710000.0e0)%360 as sid from d),
f as (select id, day, degrees(asin(sin(radians(y))*sin(dec)+cos(radians(y))*cos(dec)*cos(radians(sid+x)-ra))) as alt from e)"""


@query("solar_exposure_r33", f"""
with {SUN} select id, strftime(day,'%Y-%m-%d') as day,
round(sum(case when alt>0 then power(0.7e0, case when alt>5 then 1/cos(radians(90-alt)) else 10 end)*sin(radians(alt)) else 0 end),5) as exposure,
count(*) filter (where alt>0)*1.0e0 as daylight_hours, round(max(alt),3) as max_altitude from f group by id, day""")
def _(fx):
    out = T.solar_exposure(fx.places, ["2024-06-21", "2024-12-21"])
    return rounded(rounded(out, 5, "exposure"), 3, "max_altitude")
