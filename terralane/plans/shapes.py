"""Queries for overlays, dissolves and buffers that return polygons.

Parcels and zones have whole corners here, so a region is a set of unit cells: its area is their number F, its perimeter
4 F - 2 E with E neighbouring pairs, and its rings counted outer less holes F - E + Q with Q full blocks of four.
"""

from pyspark.sql import functions as F

from terralane.functions import geometry as G
from terralane.operators import shapes as S
from terralane.operators import topology as T
from terralane.operators import voronoi as V
from terralane.operators.joins import BOX, spatial_join_agg
from terralane.plans.joins import boxed
from terralane.plans.layers import notched, rounded
from terralane.plans.registry import query

HOLE_LOW, HOLE_HIGH = 12, 28
#: Cells of the notched parcels and of the zones with a square hole.
CELLS = f"""ca as (select id, kind, cx, cy from fx_parcels, unnest(generate_series(cast(minx as bigint), cast(maxx as bigint)-1)) x(cx),
 unnest(generate_series(cast(miny as bigint), cast(maxy as bigint)-1)) y(cy) where not (cx = minx and cy >= miny+2)),
cb as (select id, cx, cy from fx_zones, unnest(generate_series(cast(minx as bigint), cast(maxx as bigint)-1)) x(cx),
 unnest(generate_series(cast(miny as bigint), cast(maxy as bigint)-1)) y(cy)
 where not (cx >= minx+{HOLE_LOW} and cx < minx+{HOLE_HIGH} and cy >= miny+{HOLE_LOW} and cy < miny+{HOLE_HIGH}))"""
BOTH = "select ca.id as a_id, cb.id as b_id, cx, cy from ca join cb using (cx, cy)"
ONLY_A = "select ca.id as a_id, cast(null as bigint) as b_id, cx, cy from ca anti join (select distinct cx, cy from cb) using (cx, cy)"
ONLY_B = "select cast(null as bigint) as a_id, cb.id as b_id, cx, cy from cb anti join (select distinct cx, cy from ca) using (cx, cy)"


def measured(cells: str, *keys: str) -> str:
    """Area, perimeter and outer rings less holes of the cell sets of some keys."""
    own = ", ".join(keys)
    part = f"partition by {own}, " if keys else "partition by "
    return f"""with {CELLS}, r as ({cells}),
w as (select {own + ', ' if keys else ''}cx, cy, lead(cx) over ({part}cy order by cx) = cx+1 as to_right, lead(cy) over ({part}cx order by cy) = cy+1 as up from r),
z as (select *, to_right and lead(to_right) over ({part}cx order by cy) and up and lead(up) over ({part}cy order by cx) as block from w)
select {own + ', ' if keys else ''}count(*)*1.0e0 as area, count(*)*4.0e0 - 2.0e0*(count(*) filter (to_right) + count(*) filter (up)) as perimeter,
 count(*) - count(*) filter (to_right) - count(*) filter (up) + count(*) filter (block) as outer_less_holes from z {'group by ' + own if keys else ''}"""


def holed_zones(fx):
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    low, high = float(HOLE_LOW), float(HOLE_HIGH)
    outer = F.array(G.xy(x0, y0), G.xy(x1, y0), G.xy(x1, y1), G.xy(x0, y1), G.xy(x0, y0))
    hole = F.array(G.xy(x0 + low, y0 + low), G.xy(x0 + low, y0 + high), G.xy(x0 + high, y0 + high), G.xy(x0 + high, y0 + low), G.xy(x0 + low, y0 + low))
    return fx.zones.withColumn("geom", G.geometry("Polygon", F.array(outer, hole)))


def shown(df, *keys):
    geom = F.col("geom")
    turns = F.transform(geom["rings"], lambda r: F.when(G.ring_signed_area(r) > 0, F.lit(1)).otherwise(F.lit(-1)))
    out = df.select(*keys, G.polygon_area(geom).alias("area"), G.path_length(geom).alias("perimeter"),
                    F.aggregate(turns, F.lit(0).cast("long"), lambda a, b: a + b).alias("outer_less_holes"))
    return rounded(out, 6, "area", "perimeter")


def overlaid(fx, how):
    return shown(S.overlay_shapes(notched(fx), holed_zones(fx), how), "a_id", "b_id")


@query("overlay_shapes_intersection_o1", measured(BOTH, "a_id", "b_id"))
def _(fx):
    return overlaid(fx, "intersection")


@query("overlay_shapes_union_o2", measured(f"{BOTH} union all {ONLY_A} union all {ONLY_B}", "a_id", "b_id"))
def _(fx):
    return overlaid(fx, "union")


@query("overlay_shapes_difference_o3", measured(ONLY_A, "a_id", "b_id"))
def _(fx):
    return overlaid(fx, "difference")


@query("overlay_shapes_symmetric_o4", measured(f"{ONLY_A} union all {ONLY_B}", "a_id", "b_id"))
def _(fx):
    return overlaid(fx, "symmetric_difference")


@query("overlay_shapes_identity_o6", measured(f"{BOTH} union all {ONLY_A}", "a_id", "b_id"))
def _(fx):
    return overlaid(fx, "identity")


@query("dissolve_shapes_o7", measured("select distinct kind, cx, cy from ca", "kind"))
def _(fx):
    return shown(S.dissolve_shapes(notched(fx), "kind"), "kind")


@query("dissolve_shapes_all_o7", measured("select distinct cx, cy from ca"))
def _(fx):
    return shown(S.dissolve_shapes(notched(fx)))


# strips along the edges, five corner arcs, and a square counted twice at the inner corner
@query("buffer_polygon_shapes_p12", """
with s as (select id, maxx-minx as w, maxy-miny as h, 0.5e0 as d from fx_parcels)
select id, round(w*h-(h-2) + (2*w+2*h)*d + 1.25e0*32*sin(2*pi()/64)*d*d - d*d, 6) as area from s""")
def _(fx):
    return rounded(S.buffer_shapes(notched(fx), 0.5), 6, "area").select("id", "area")


# a straight line: a rectangle and two half circles of 64-gon arcs, each beginning and ending inside a step
@query("buffer_line_shapes_p12", """
with s as (select id, maxx-minx as w, maxy-miny as h, 1.5e0 as d, 2*pi()/64 as step from fx_parcels),
t as (select *, atan2(-w, h)/step as turns from s), u as (select *, (ceil(turns)-turns)*step as part from t)
select id, round(2*d*sqrt(w*w+h*h) + d*d*case when part<1e-9 then 32*sin(step) else 31*sin(step)+sin(part)+sin(step-part) end, 6) as area from u""")
def _(fx):
    line = F.array(G.xy(F.col("minx"), F.col("miny")), G.xy(F.col("maxx"), F.col("maxy")))
    lines = boxed(fx.parcels).withColumn("geom", G.geometry("LineString", F.array(line)))
    return rounded(S.buffer_shapes(lines, 1.5), 6, "area").select("id", "area")


# a lattice of 40 x 40 plots whose shared borders have a middle vertex up to one unit aside; those within 0.6 go
@query("simplify_topology_p11", """
with s as (select p_partkey as id, p_partkey%100 as a, p_partkey//100 as b from part),
o as (select id, (((a*7+b*3)%5)-2)*0.5e0 as low, (((a+1)*5+b*11)%5-2)*0.5e0 as rgt, ((a*7+(b+1)*3)%5-2)*0.5e0 as upp, ((a*5+b*11)%5-2)*0.5e0 as lft from s)
select id, cast(9 as int) as vertices_before, cast(5+(abs(low)>0.6)::int+(abs(rgt)>0.6)::int+(abs(upp)>0.6)::int+(abs(lft)>0.6)::int as int) as vertices_after,
 1600+20*(if(abs(rgt)>0.6,rgt,0)-if(abs(lft)>0.6,lft,0)+if(abs(upp)>0.6,upp,0)-if(abs(low)>0.6,low,0)) as area from o""")
def _(fx):
    plots = fx.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).alias("a"), F.floor(F.col("p_partkey") / 100).alias("b"))
    a, b = F.col("a"), F.col("b")
    aside = lambda x: (F.pmod(x, F.lit(5)) - 2) * 0.5
    low, right, up, left = aside(a * 7 + b * 3), aside((a + 1) * 5 + b * 11), aside(a * 7 + (b + 1) * 3), aside(a * 5 + b * 11)
    x, y = a * 40.0, b * 40.0
    ring = F.array(G.xy(x, y), G.xy(x + 20, y + low), G.xy(x + 40, y), G.xy(x + 40 + right, y + 20), G.xy(x + 40, y + 40),
                   G.xy(x + 20, y + 40 + up), G.xy(x, y + 40), G.xy(x + left, y + 20), G.xy(x, y))
    out = T.simplify_topology(plots.select("id", G.geometry("Polygon", F.array(ring)).alias("geom")), 0.6)
    return rounded(out.withColumn("area", G.polygon_area(F.col("geom"))), 6, "area").select("id", "vertices_before", "vertices_after", "area")


# cell middles of a grid fall into the polygon of their nearest seed
@query("voronoi_shapes_o10", """
with b as (select min(x)-0.01e0 as x0, min(y)-0.01e0 as y0, max(x)+0.01e0 as x1, max(y)+0.01e0 as y1 from fx_facilities),
g as (select i, (i%60+0.5e0)*((x1-x0)/60)+x0 as x, (i//60+0.5e0)*((y1-y0)/50)+y0 as y from (select unnest(generate_series(0,2999)) as i) cross join b),
n as (select i, arg_min(f.id, sqrt((g.x-f.x)*(g.x-f.x)+(g.y-f.y)*(g.y-f.y))) as id from g cross join fx_facilities f group by i)
select f.id, count(n.i) as middles, (select round((x1-x0)*(y1-y0), 6) from b) as whole from fx_facilities f left join n on n.id=f.id group by f.id""")
def _(fx):
    cells = G.with_bounds(V.voronoi(fx.facilities))
    x0, y0, x1, y1 = (F.min("x") - 0.01).alias("x0"), (F.min("y") - 0.01).alias("y0"), (F.max("x") + 0.01).alias("x1"), (F.max("y") + 0.01).alias("y1")
    grid = fx.facilities.agg(x0, y0, x1, y1).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2999).cast("long"))))
    grid = grid.select(F.col("i").alias("id"), ((F.col("i") % 60 + 0.5) * ((F.col("x1") - F.col("x0")) / 60) + F.col("x0")).alias("x"),
                       ((F.floor(F.col("i") / 60) + 0.5) * ((F.col("y1") - F.col("y0")) / 50) + F.col("y0")).alias("y"))
    counted = spatial_join_agg(cells.select("id", "geom", *BOX), grid, {"middles": ("count", "*")}).select("id", "middles")
    return counted.crossJoin(F.broadcast(cells.agg(F.round(F.sum("area"), 6).alias("whole"))))
