"""Queries for overlay, hull, allocation and siting operators."""

from pyspark.sql import functions as F

from terralane.functions import geometry as G


from terralane.operators import overlay as O
from terralane.operators import raster as R
from terralane.operators import siting as S
from terralane.plans.joins import boxed, hav
from terralane.plans.layers import notched, rounded
from terralane.plans.rasters import GRID
from terralane.plans.shapes import holed_zones
from terralane.plans.registry import query

# whole-unit cells of the parcels and of the zones, which have a square hole each
ACOV = "a as (select id, cx, cy from fx_parcels, unnest(generate_series(cast(minx as bigint), cast(maxx as bigint)-1)) x(cx), unnest(generate_series(cast(miny as bigint), cast(maxy as bigint)-1)) y(cy))"
BCOV = "b as (select id, cx, cy from fx_zones, unnest(generate_series(cast(minx as bigint), cast(maxx as bigint)-1)) x(cx), unnest(generate_series(cast(miny as bigint), cast(maxy as bigint)-1)) y(cy) where not (cx>=minx+12 and cx<minx+28 and cy>=miny+12 and cy<miny+28))"


def overlaid(fx, how):
    cells = O.overlay(boxed(fx.parcels), holed_zones(fx), how, 1.0)
    return O.overlay_area(cells, 1.0)


SUMS = "count(*) as cells, count(*)*1.0e0 as area"


@query("overlay_intersection_o1", f"""
with {ACOV}, {BCOV} select a.id as a_id, b.id as b_id, {SUMS} from a join b using (cx, cy) group by 1, 2""")
def _(fx):
    return overlaid(fx, "intersection")


@query("overlay_intersection_exact_o1", """
select a.id as a_id, b.id as b_id, round((least(a.maxx,b.maxx)-greatest(a.minx,b.minx))*(least(a.maxy,b.maxy)-greatest(a.miny,b.miny))
 -greatest(0,least(a.minx+1,b.maxx)-greatest(a.minx,b.minx))*greatest(0,least(a.maxy,b.maxy)-greatest(a.miny+2,b.miny)),6) as area
from fx_parcels a join fx_zones b on a.minx<b.maxx and b.minx<a.maxx and a.miny<b.maxy and b.miny<a.maxy and
 (least(a.maxx,b.maxx)-greatest(a.minx,b.minx))*(least(a.maxy,b.maxy)-greatest(a.miny,b.miny))
 -greatest(0,least(a.minx+1,b.maxx)-greatest(a.minx,b.minx))*greatest(0,least(a.maxy,b.maxy)-greatest(a.miny+2,b.miny))>0""")
def _(fx):
    out = O.intersect_convex(notched(fx), boxed(fx.zones))
    return rounded(out, 6, "area").select("a_id", "b_id", "area")


@query("overlay_union_o2", f"""
with {ACOV}, {BCOV} select a.id as a_id, b.id as b_id, {SUMS} from a full join b using (cx, cy) group by 1, 2""")
def _(fx):
    return overlaid(fx, "union")


@query("overlay_difference_o3", f"""
with {ACOV}, {BCOV} select a.id as a_id, cast(null as bigint) as b_id, {SUMS} from a
where not exists (select 1 from b where b.cx=a.cx and b.cy=a.cy) group by 1""")
def _(fx):
    return overlaid(fx, "difference")


@query("overlay_symmetric_o4", f"""
with {ACOV}, {BCOV} select a.id as a_id, b.id as b_id, {SUMS} from a full join b using (cx, cy)
where a.id is null or b.id is null group by 1, 2""")
def _(fx):
    return overlaid(fx, "symmetric_difference")


@query("clip_o5", """
select a.id, a.kind, round(sum((least(a.maxx,b.maxx)-greatest(a.minx,b.minx))*(least(a.maxy,b.maxy)-greatest(a.miny,b.miny))),6) as area
from fx_parcels a join fx_zones b on b.landuse=3 and a.minx<b.maxx and b.minx<a.maxx and a.miny<b.maxy and b.miny<a.maxy
group by a.id, a.kind""")
def _(fx):
    pieces = O.clip(boxed(fx.parcels), boxed(fx.zones.filter("landuse = 3")))
    return pieces.groupBy("id", "kind").agg(F.round(F.sum("area"), 6).alias("area"))


@query("clip_cells_of_layer_o5", f"""
with {ACOV}, {BCOV} select id, count(*) as cells from a where exists (select 1 from b where b.cx=a.cx and b.cy=a.cy) group by id""")
def _(fx):
    return O.clip_coverage(boxed(fx.parcels), holed_zones(fx), 1.0).groupBy("id").agg(F.count("*").alias("cells"))


@query("overlay_identity_o6", f"""
with {ACOV}, {BCOV} select a.id as a_id, b.id as b_id, {SUMS} from a left join b using (cx, cy) group by 1, 2""")
def _(fx):
    return overlaid(fx, "identity")


@query("dissolve_o7", f"""
with {ACOV}, d as (select distinct p.kind, a.cx, a.cy from a join fx_parcels p on p.id=a.id),
k as (select kind, count(*) as cells from d group by kind)
select k.kind, count(*) as features, k.cells, k.cells*1.0e0 as area from fx_parcels p join k on k.kind=p.kind group by k.kind, k.cells""")
def _(fx):
    return O.dissolve(boxed(fx.parcels), 1.0, "kind")


@query("dissolve_all_o7", f"""
with {ACOV} select (select count(*) from fx_parcels) as features, count(*) as cells, count(*)*1.0e0 as area,
(select kind from fx_parcels where id=0) as kind from (select distinct cx, cy from a)""")
def _(fx):
    return O.dissolve(boxed(fx.parcels), 1.0)


# a point is a hull vertex direction if it is extreme there; compare support in 16 directions
@query("convex_hull_o9", """
with d as (select i, cos(2*pi()*i/16) as dx, sin(2*pi()*i/16) as dy from (select unnest(generate_series(0,15)) as i))
select grp, i as direction, round(max(x*dx+y*dy),9) as support from fx_places cross join d group by grp, i""")
def _(fx):
    hull = O.convex_hull(fx.places, "grp")
    v = hull.select("grp", F.explode(G.vertices(F.col("geom"))).alias("p")).withColumn(
        "direction", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")))
    angle = F.col("direction") * F.lit(2.0) * F.pi() / 16
    return v.groupBy("grp", "direction").agg(
        F.round(F.max(F.col("p.x") * F.cos(angle) + F.col("p.y") * F.sin(angle)), 9).alias("support"))


@query("nearest_seed_allocation_o10", """
with b as (select min(x)-0.01e0 as x0, min(y)-0.01e0 as y0, max(x)+0.01e0 as x1, max(y)+0.01e0 as y1 from fx_facilities),
g as (select i, (i%60+0.5e0)*((x1-x0)/60)+x0 as x, (i//60+0.5e0)*((y1-y0)/50)+y0 as y, (x1-x0)/60*((y1-y0)/50) as a
 from (select unnest(generate_series(0,2999)) as i) cross join b),
d as (select g.i, g.a, f.id, sqrt((g.x-f.x)*(g.x-f.x)+(g.y-f.y)*(g.y-f.y)) as d from g cross join fx_facilities f),
n as (select *, row_number() over (partition by i order by d, id) as rn from d)
select id as seed, count(*) as cells, round(count(*)*any_value(a),8) as area from n where rn=1 group by id""")
def _(fx):
    return rounded(O.nearest_seed_allocation(fx.facilities, 50, 60), 8, "area")


SEG = """s as (select id, i, x, y, lead(x) over (partition by id order by i) as qx, lead(y) over (partition by id order by i) as qy
 from (select p_partkey as id, i, 1.0e0*((p_partkey*17)%211)*3+i*2 as x, 1.0e0*((p_partkey*29)%199)*3+((p_partkey+i*i)%5) as y
 from part cross join (select unnest(generate_series(0,4)) as i)))"""


def planar_paths(fx):
    """Five-vertex lines in the parcel plane."""
    k = F.col("p_partkey")

    def vertex(i):
        return G.xy(((k * 17) % 211) * F.lit(3.0) + i * 2, ((k * 29) % 199) * F.lit(3.0) + (k + i * i) % 5)
    line = F.transform(F.sequence(F.lit(0), F.lit(4)), vertex)
    return G.with_bounds(fx.part.select(k.alias("id"), G.geometry("LineString", F.array(line)).alias("geom")))


@query("buffer_lines_p12", f"""
with {SEG}, c as (select s.id, cx, cy, cx+0.5e0 as px, cy+0.5e0 as py, x, y, qx-x as dx, qy-y as dy from s,
 unnest(generate_series(cast(floor(least(x,qx)-2) as bigint)-1, cast(ceil(greatest(x,qx)+2) as bigint))) u(cx),
 unnest(generate_series(cast(floor(least(y,qy)-2) as bigint)-1, cast(ceil(greatest(y,qy)+2) as bigint))) w(cy) where qx is not null),
f as (select *, greatest(0,least(1,((px-x)*dx+(py-y)*dy)/(dx*dx+dy*dy))) as t from c)
select id, count(distinct (cx,cy)) as cells from f where sqrt(power(px-(x+t*dx),2)+power(py-(y+t*dy),2))<=1.6 group by id""")
def _(fx):
    return O.buffer_cells(planar_paths(fx), 1.6, 1.0).groupBy("id").agg(F.count("*").alias("cells"))


@query("buffer_dissolved_p12", """
with c as (select distinct cx, cy from fx_parcels,
 unnest(generate_series(cast(minx as bigint)-3, cast(maxx as bigint)+2)) u(cx),
 unnest(generate_series(cast(miny as bigint)-3, cast(maxy as bigint)+2)) w(cy)
 where power(greatest(0,minx-cx-0.5e0,cx+0.5e0-maxx),2)+power(greatest(0,miny-cy-0.5e0,cy+0.5e0-maxy),2)<=4)
select count(*) as cells from c""")
def _(fx):
    return O.buffer_cells(boxed(fx.parcels), 2.0, 1.0, dissolve=True).agg(F.count("*").alias("cells"))


@query("road_minus_river_area")
def _(fx):
    """Buffered lines minus buffered lines, area by kind of line."""
    lines = planar_paths(fx)
    roads, rivers = lines.filter("id % 3 <> 0"), lines.filter("id % 3 = 0")
    land = O.buffer_cells(roads.withColumn("kind", F.col("id") % 4), 2.0, 1.0)
    left = O.cells_difference(land, O.buffer_cells(rivers, 1.0, 1.0, dissolve=True))
    return O.overlay_area(left, 1.0, "kind")


# ---------------------------------------------------------------- siting

@query("gravity_access_t12", """
with p as (select id, x*100000 as x, y*100000 as y, abs(v) as pop from fx_places), f as (select id, x*100000 as x, y*100000 as y from fx_facilities),
s as (select (select sum(pop) from p)/(select count(*) from f) as a),
d as (select f.id, sum(case when sqrt(power(p.x-f.x,2)+power(p.y-f.y,2))>100 then p.pop/(power(p.x-f.x,2)+power(p.y-f.y,2)) else 0 end)*any_value(a) as acc
from f cross join p cross join s group by f.id) select id, round(acc,4) as accessibility, rank() over (order by acc desc) as rank from d""")
def _(fx):
    def metres(df):
        return df.withColumns({"x": F.col("x") * 100000, "y": F.col("y") * 100000})
    demand = metres(fx.places).withColumn("pop", F.abs("v"))
    return rounded(S.gravity_access(demand, metres(fx.facilities), "pop"), 4, "accessibility")


@query("location_allocation_t13", """
with d as (select f.id, p.id as pid, sqrt(power(p.x-f.x,2)+power(p.y-f.y,2)) as d from fx_facilities f cross join fx_places p),
n as (select *, row_number() over (partition by id order by d, pid) as rn from d)
select id, round(sum(d)*111000,4) as cost from n where rn<=10 group by id order by sum(d), id limit 5""")
def _(fx):
    return rounded(S.location_allocation(fx.facilities, fx.places, 5), 4, "cost")


def study_cells(fx):
    """Centres of the elevation cells with a row-major id."""
    return R.with_centers(fx.dem.select("r", "c"), GRID).withColumn("id", F.col("r") * 500 + F.col("c"))


STUDY = "k as (select r*500+c as id, r, c, 116.0e0+(c+0.5e0)*0.002e0 as x, 40.5e0+(r+0.5e0)*-0.002e0 as y from fx_dem)"
FREE = f"""{STUDY}, ok as materialized (select k.* from k where
 exists (select 1 from fx_pois p where sqrt(power(k.x-p.x,2)+power(k.y-p.y,2))<=0.03)
 and not exists (select 1 from fx_facilities f where sqrt(power(k.x-f.x,2)+power(k.y-f.y,2))<0.05)
 and exists (select 1 from fx_districts d where d.grp<3 and k.x between d.minx and d.maxx and k.y between d.miny and d.maxy))"""


def free_cells(fx):
    layers = {"shop": fx.pois, "plant": fx.facilities,
              "zone": boxed(fx.districts).withColumn("landuse", F.when(F.col("grp") < 3, "Industrial north").otherwise("park"))}
    return S.constrain_area(study_cells(fx), layers, [
        ("shop", "distance<=0.03"), ("plant", "distance>=0.05"), ("zone", "landuse=industrial")])


@query("constrain_area_t14", f"with {FREE} select id, r, c from ok")
def _(fx):
    return free_cells(fx).select("id", "r", "c")


@query("constrain_area_lines_t14", """
with z as (select x*10000+y*10 as id, 2*x+1.0e0 as x, 2*y+1.0e0 as y from
 (select unnest(generate_series(0,319)) as x) cross join (select unnest(generate_series(0,319)) as y))
select z.id from z where exists (select 1 from fx_parcels p where
 sqrt(power(greatest(0,p.minx-z.x,z.x-p.maxx),2)+power(greatest(0,p.miny-z.y,z.y-p.maxy),2))<=1.2)""")
def _(fx):
    side = 320        # cells of two units over the whole plane of the parcels
    k = F.col("id")
    cells = fx.spark.range(side * side).select(
        (F.floor(k / side) * 10000 + (k % side) * 10).alias("id"), (F.floor(k / side) * 2 + 1.0).alias("x"),
        (k % side * 2 + 1.0).alias("y"))
    return S.constrain_area(cells, {"parcel": boxed(fx.parcels)}, [("parcel", "distance<=1.2")]).select("id")


@query("candidate_sites_t15", f"""
with recursive {FREE}, e as materialized (select a.r*500+a.c as i, b.r*500+b.c as j from ok a join ok b on abs(a.r-b.r)+abs(a.c-b.c)=1),
lab(id, m) using key (id) as (select id, id from ok union
 (select e.i, min(l.m) from lab l join e on e.j=l.id join recurring.lab q on q.id=e.i where l.m<q.m group by e.i)),
comp as (select id, m as component from lab),
m as (select comp.component, ok.r, ok.c, count(*) over (partition by component)*400.0e0 as part_area,
 min(r) over (partition by component) as r0, max(r) over (partition by component) as r1,
 min(c) over (partition by component) as c0, max(c) over (partition by component) as c1 from comp join ok on ok.id=comp.id),
p as (select component, case when part_area>100000 then least(4,(c-c0)*5//(c1-c0+1))*5+least(4,(r-r0)*5//(r1-r0+1)) else 0 end::bigint as piece, r, c
 from m where part_area>5000)
select (component//500)*4294967296+component%500 as component, piece, count(*) as cells, count(*)*400.0e0 as area,
 round((avg(c)+0.5e0)*20,4) as x, round((avg(r)+0.5e0)*20,4) as y
from p group by component, piece having count(*)*400>5000""")
def _(fx):
    return rounded(S.candidate_sites(free_cells(fx), 20.0), 4, "x", "y")


SCORE = """s as (select f.id, min(sqrt(power(f.x-p.x,2)+power(f.y-p.y,2))) as d1 from fx_places f cross join fx_facilities p group by f.id),
t as (select f.id, min(sqrt(power(f.x-p.x,2)+power(f.y-p.y,2))) as d2 from fx_places f cross join fx_pois p where p.kind=3 group by f.id)"""


@query("rank_sites_t16", f"""
with {SCORE} select id, round(greatest(0, 100+case when d1<=0.03 then 2*20*(1-d1/0.03e0) else -60 end
+case when d2>=0.02 then 20*least(0.02e0/greatest(d2,1),1) else -30*(1-d2/0.02e0) end),6) as score
from s join t using (id) order by score desc, id limit 20""")
def _(fx):
    out = S.rank_sites(fx.places.select("id", "x", "y"), {"plant": fx.facilities, "noise": fx.pois.filter("kind = 3")},
                       [("plant", "distance<=0.03"), ("noise", "distance>=0.02")], {"plant": 2.0})
    return rounded(out, 6, "score").orderBy(F.col("score").desc(), "id").limit(20).select("id", "score")


@query("impact_stats_t17", """
with d as (select f.id, p.id as pid, p.name, row_number() over (partition by f.id order by p.id) as rn from fx_facilities f join fx_pois p
on sqrt(power(f.x-p.x,2)+power(f.y-p.y,2))<=0.05)
select f.id, count(d.pid) as residential_count, string_agg(d.name, ',' order by d.rn) filter (where d.rn<=10) as names
from fx_facilities f left join d on d.id=f.id group by f.id""")
def _(fx):
    out = S.impact_stats(fx.facilities, fx.pois, 0.05)
    return out.select("id", "residential_count", F.array_join("names", ",").alias("names"))


@query("mcda_grid_t18", """
with g as (select i as id, 30.0e0*(i//19+1) as x, 30.0e0*(i%19+1) as y from (select unnest(generate_series(0,18*19-1)) as i)),
n as (select cast(minx as double) as x, cast(miny as double) as y from fx_parcels),
d as (select g.id, min(sqrt(power(g.x-n.x,2)+power(g.y-n.y,2))) as d from g cross join n group by g.id),
b as (select g.id, sum((p.maxx-p.minx)*(p.maxy-p.miny)) as a from g join fx_parcels p on p.minx<=g.x+15 and p.maxx>=g.x-15 and p.miny<=g.y+15 and p.maxy>=g.y-15 group by g.id),
s as (select g.id, g.x, g.y, 1-d.d/max(d.d) over () as road, coalesce(b.a,0)/max(coalesce(b.a,0)) over () as pop from g join d using (id) left join b using (id)),
t as (select *, 0.5e0*road+0.3e0*pop+0.1e0 as sc from s)
select id, x, y, round(road,6) as road_access, round(pop,6) as pop_density, round(sc,6) as total_score,
row_number() over (order by sc desc, id) as rank from t order by sc desc, id limit 15""")
def _(fx):
    nodes = fx.parcels.select("id", F.col("minx").alias("x"), F.col("miny").alias("y"))
    out = S.mcda_grid((0, 0, 570, 600), nodes, boxed(fx.parcels),
                      {"road_access": 0.5, "pop_density": 0.3, "vegetation": 0.2}, 15, step=30.0)
    return rounded(out, 6, "road_access", "pop_density", "total_score")


CAND = f"""ctr as (select 116.4e0 as x, 39.9e0 as y),
grid as (select i//51-25 as i, i%51-25 as j from (select unnest(generate_series(0,2600)) as i)),
gc as (select concat('grid(', i, ',', j, ')') as name, 116.4e0+j*(6000.0e0/111000/50/cos(radians(39.9e0))) as x,
 39.9e0+i*(6000.0e0/111000/50) as y, 1 as o, -1 as poi from grid),
cand as (select name, x, y, 0 as o, id as poi from fx_pois where kind=1 union all select name, x, y, o, poi from gc),
cc as (select a.*, {hav('a', 'b')} as cd from cand a cross join ctr b),
cf as (select *, row_number() over (partition by round(x,6), round(y,6) order by o, poi, name) as rn from cc where o=0 or cd<=6000),
c1 as (select * from cf where rn=1),
n1 as (select a.name, min({hav('a', 'b')}) as d1 from c1 a cross join (select * from fx_pois where kind=1) b group by a.name),
n2 as (select a.name, min({hav('a', 'b')}) as d2 from c1 a cross join (select * from fx_pois where kind=4) b group by a.name)"""


@query("multi_criteria_search_t19", f"""
with {CAND} select name, round(x,6) as x, round(y,6) as y, round(-cd/100-d1/100+d2/50,4) as score
from c1 join n1 using (name) join n2 using (name) where d1<=2500 and d2>=1500 order by -cd/100-d1/100+d2/50 desc limit 10""")
def _(fx):
    out = S.multi_criteria_search(fx.pois, (116.4, 39.9), [(1, 2500.0)], [(4, 1500.0)], 6000.0)
    return rounded(rounded(out, 6, "x", "y"), 4, "score").select("name", "x", "y", "score")


@query("exclusion_search_t20", f"""
with ctr as (select 116.4e0 as x, 39.9e0 as y), c as (select a.id, a.name, a.x, a.y, {hav('a', 'b')} as cd from fx_pois a cross join ctr b),
e as (select a.id, min({hav('a', 'b')}) as de from fx_pois a cross join (select * from fx_pois where kind=2) b group by a.id),
n as (select a.id, min({hav('a', 'b')}) as dn from fx_pois a cross join (select * from fx_pois where kind=5) b group by a.id),
f as (select a.id, min({hav('a', 'b')}) as df from fx_pois a cross join (select * from fx_pois where kind=0) b group by a.id)
select name, round(-cd/100-dn/100+df/50+(de-1200)/200,4) as score from c join e using (id) join n using (id) join f using (id)
where de>1200 and dn<=6000 and df>=800 order by -cd/100-dn/100+df/50+(de-1200)/200 desc, id limit 10""")
def _(fx):
    out = S.exclusion_search(fx.pois, (116.4, 39.9), [(2, 1200.0)], [(5, 6000.0)], [(0, 800.0)])
    return rounded(out, 4, "score").select("name", "score")


@query("siting_with_defaults")
def _(fx):
    """Constraint siting end to end: free cells, parts, score and impact."""
    sites = S.candidate_sites(free_cells(fx), 20.0)
    sites = sites.withColumns({"id": F.col("component") * 25 + F.col("piece"),
                               "x": F.col("x") / 20 * 0.002 + 116.0, "y": F.lit(40.5) - F.col("y") / 20 * 0.002})
    ranked = S.rank_sites(sites.select("id", "x", "y", "area"), {"shop": fx.pois, "plant": fx.facilities},
                          [("shop", "distance<=0.03"), ("plant", "distance>=0.05")], top=5)
    homes = S.impact_stats(ranked, fx.pois, 0.05)
    return ranked.join(homes, "id").select("id", "area", F.round("score", 4).alias("score"), "residential_count")


