"""Column expressions over the geometry struct.

A geometry is ``STRUCT<type STRING, rings ARRAY<ARRAY<STRUCT<x,y>>>>``. Polygons
keep every ring closed, outer rings counter-clockwise and holes clockwise, so the
signed ring areas add up. Lines are open paths, points are one-vertex paths.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS = 6371000.0
GEOM_TYPE = ("struct<type:string,rings:array<array<struct<x:double,y:double>>>>")
PATH_TYPE = "array<struct<x:double,y:double>>"


def xy(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def geometry(kind: str, rings: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), rings.alias("rings"))


def point_geometry(x, y) -> Column:
    return geometry("Point", F.array(F.array(xy(x, y))))


def box_geometry(minx, miny, maxx, maxy) -> Column:
    ring = F.array(xy(minx, miny), xy(maxx, miny), xy(maxx, maxy), xy(minx, maxy), xy(minx, miny))
    return geometry("Polygon", F.array(ring))


def vertices(geom: Column) -> Column:
    return F.flatten(geom["rings"])


def edges_of_path(path: Column) -> Column:
    """Consecutive vertex pairs of one path as structs p, q."""
    n = F.size(path)
    head = F.slice(path, 1, F.greatest(n - 1, F.lit(0)))
    tail = F.slice(path, 2, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(head, tail, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def edges(geom: Column) -> Column:
    return F.flatten(F.transform(geom["rings"], edges_of_path))


def with_bounds(df, geom: str = "geom"):
    """Add minx, miny, maxx, maxy computed from the vertices."""
    v = vertices(F.col(geom))
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return df.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys),
                           "maxx": F.array_max(xs), "maxy": F.array_max(ys)})


def euclidean(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def haversine(ax, ay, bx, by, radius: float = EARTH_RADIUS) -> Column:
    """Great-circle distance of lon/lat degrees, in the unit of ``radius``."""
    ax, ay, bx, by = (F.radians(c) for c in (ax, ay, bx, by))
    s1, s2 = F.sin((by - ay) / 2), F.sin((bx - ax) / 2)
    h = s1 * s1 + F.cos(ay) * F.cos(by) * s2 * s2
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def distance(metric: str, ax, ay, bx, by) -> Column:
    if metric not in ("euclidean", "haversine"):
        raise ValueError(f"unknown metric {metric!r}; use euclidean or haversine")
    return (haversine if metric == "haversine" else euclidean)(ax, ay, bx, by)


def ring_signed_area(ring: Column) -> Column:
    """Shoelace about the first vertex, which keeps precision far from the origin."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    return F.aggregate(
        edges_of_path(ring), F.lit(0.0),
        lambda acc, e: acc + ((e["p"]["x"] - ox) * (e["q"]["y"] - oy)
                              - (e["q"]["x"] - ox) * (e["p"]["y"] - oy)) / 2)


def polygon_area(geom: Column) -> Column:
    return F.abs(F.aggregate(geom["rings"], F.lit(0.0), lambda acc, r: acc + ring_signed_area(r)))


def path_length(geom: Column, metric: str = "euclidean") -> Column:
    return F.aggregate(
        edges(geom), F.lit(0.0),
        lambda acc, e: acc + distance(metric, e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]))


def centroid(geom: Column) -> Column:
    """Area, length or vertex weighted mean, by the dimension of the geometry."""
    first = geom["rings"][0][0]
    ox, oy = first["x"], first["y"]
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))

    def moments(acc, w, mx, my):
        return F.struct((acc["w"] + w).alias("w"), (acc["sx"] + w * mx).alias("sx"),
                        (acc["sy"] + w * my).alias("sy"))

    def area_step(acc, e):
        px, py = e["p"]["x"] - ox, e["p"]["y"] - oy
        qx, qy = e["q"]["x"] - ox, e["q"]["y"] - oy
        return moments(acc, px * qy - qx * py, (px + qx) / 3, (py + qy) / 3)

    def line_step(acc, e):
        px, py = e["p"]["x"] - ox, e["p"]["y"] - oy
        qx, qy = e["q"]["x"] - ox, e["q"]["y"] - oy
        return moments(acc, F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)),
                       (px + qx) / 2, (py + qy) / 2)

    by_area = F.aggregate(edges(geom), start, area_step)
    by_line = F.aggregate(edges(geom), start, line_step)
    by_vertex = F.aggregate(vertices(geom), start,
                            lambda acc, p: moments(acc, F.lit(1.0), p["x"] - ox, p["y"] - oy))
    m = (F.when(geom["type"].contains("Polygon") & (by_area["w"] != 0), by_area)
         .when(geom["type"].contains("Line") & (by_line["w"] != 0), by_line)
         .otherwise(by_vertex))
    return F.struct((ox + m["sx"] / m["w"]).alias("x"), (oy + m["sy"] / m["w"]).alias("y"))


def map_vertices(geom: Column, fn) -> Column:
    """Apply ``fn(x, y) -> (x, y)`` to every vertex."""
    def move(p):
        nx, ny = fn(p["x"], p["y"])
        return F.struct(nx.alias("x"), ny.alias("y"))
    return F.struct(geom["type"].alias("type"),
                    F.transform(geom["rings"], lambda r: F.transform(r, move)).alias("rings"))


def _cross(ox, oy, ax, ay, bx, by) -> Column:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def is_own_box(geom: Column, minx, miny, maxx, maxy) -> Column:
    """The polygon is exactly its bounding box: one ring whose vertices are all corners."""
    ring = geom["rings"][0]
    corner = F.forall(ring, lambda p: ((p["x"] == minx) | (p["x"] == maxx))
                      & ((p["y"] == miny) | (p["y"] == maxy)))
    full = F.abs(ring_signed_area(ring)) >= (maxx - minx) * (maxy - miny) * (1 - 1e-9)
    return (F.size(geom["rings"]) == 1) & (F.size(ring) == 5) & corner & full


def on_edge(e: Column, x: Column, y: Column) -> Column:
    px, py, qx, qy = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
    return ((_cross(px, py, qx, qy, x, y) == 0)
            & (x >= F.least(px, qx)) & (x <= F.greatest(px, qx))
            & (y >= F.least(py, qy)) & (y <= F.greatest(py, qy)))


def on_boundary(geom: Column, x: Column, y: Column) -> Column:
    return F.exists(edges(geom), lambda e: on_edge(e, x, y))


def locate(edge_list: Column, x: Column, y: Column) -> Column:
    """0 outside, 1 inside, 2 on the boundary; one pass over the edges."""
    def step(acc, e):
        px, py, qx, qy = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
        # straddling edges have py != qy, so the divisor is never zero there
        hit = (((py > y) != (qy > y))
               & (x < (qx - px) * (y - py) / F.when(qy != py, qy - py).otherwise(F.lit(1.0)) + px))
        return (F.when(acc == 2, F.lit(2)).when(on_edge(e, x, y), F.lit(2))
                .when(hit, F.lit(1) - acc).otherwise(acc))
    return F.aggregate(edge_list, F.lit(0), step)


def covers_point(geom: Column, x: Column, y: Column) -> Column:
    """Point inside or on the boundary of a polygon."""
    return locate(edges(geom), x, y) > 0


def contains_point(geom: Column, x: Column, y: Column) -> Column:
    """Point strictly inside a polygon."""
    return locate(edges(geom), x, y) == 1


def _orient(e: Column, p: Column) -> Column:
    return F.signum(_cross(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"], p["x"], p["y"]))


def segments_cross(e: Column, f: Column) -> Column:
    """Interiors cross at one point."""
    return ((_orient(e, f["p"]) * _orient(e, f["q"]) < 0)
            & (_orient(f, e["p"]) * _orient(f, e["q"]) < 0))


def segments_touch(e: Column, f: Column) -> Column:
    """Share at least one point."""
    return (segments_cross(e, f)
            | on_edge(e, f["p"]["x"], f["p"]["y"]) | on_edge(e, f["q"]["x"], f["q"]["y"])
            | on_edge(f, e["p"]["x"], e["p"]["y"]) | on_edge(f, e["q"]["x"], e["q"]["y"]))


def prepare(geom: Column) -> Column:
    """Vertices and edges of a geometry, computed once per feature before a join."""
    return F.struct(geom["type"].alias("type"), vertices(geom).alias("v"), edges(geom).alias("e"))


def _any_edge_pair(a: Column, b: Column, test) -> Column:
    return F.exists(a["e"], lambda e: F.exists(b["e"], lambda f: test(e, f)))


def _contacts(e: Column, f: Column) -> Column:
    """Where, between 0 and 1 along e, the edge f meets it: crossings and ends of f; null elsewhere."""
    px, py, dx, dy = e["p"]["x"], e["p"]["y"], e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
    fx, fy = f["q"]["x"] - f["p"]["x"], f["q"]["y"] - f["p"]["y"]
    turn = dx * fy - dy * fx
    long = dx * dx + dy * dy
    some = F.when(turn == 0, F.lit(1.0)).otherwise(turn)
    at = ((f["p"]["x"] - px) * fy - (f["p"]["y"] - py) * fx) / some
    along = ((f["p"]["x"] - px) * dy - (f["p"]["y"] - py) * dx) / some
    crossing = F.when((turn != 0) & at.between(0.0, 1.0) & along.between(0.0, 1.0), at)

    def end(p):
        return F.when(on_edge(e, p["x"], p["y"]) & (long > 0), ((p["x"] - px) * dx + (p["y"] - py) * dy)
                      / F.when(long > 0, long).otherwise(F.lit(1.0)))
    return F.array(crossing, end(f["p"]), end(f["q"]))


def _probe_points(a: Column, b: Column) -> Column:
    """Vertices of a, and the middle of every piece that the edges of b cut its edges into."""
    def middles(e):
        met = F.flatten(F.transform(b["e"], lambda f: _contacts(e, f)))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(met, lambda t: t.isNotNull()))))
        halves = F.transform(F.array(cuts), lambda c: F.zip_with(
            F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda s, t: (s + t) / 2))
        return F.transform(F.flatten(halves), lambda t: xy(e["p"]["x"] + t * (e["q"]["x"] - e["p"]["x"]),
                                                           e["p"]["y"] + t * (e["q"]["y"] - e["p"]["y"])))
    return F.concat(a["v"], F.flatten(F.transform(a["e"], middles)))


def _along(a: Column, p: Column) -> Column:
    """On an edge of a, but for rounding of a point computed on another edge."""
    def close(e):
        dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        size = F.abs(dx) + F.abs(dy)
        slack = size * 1e-12
        return ((F.abs(_cross(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"], p["x"], p["y"])) <= size * size * 1e-12)
                & p["x"].between(F.least(e["p"]["x"], e["q"]["x"]) - slack, F.greatest(e["p"]["x"], e["q"]["x"]) + slack)
                & p["y"].between(F.least(e["p"]["y"], e["q"]["y"]) - slack, F.greatest(e["p"]["y"], e["q"]["y"]) + slack))
    return F.exists(a["e"], close)


def is_polygon(geom: Column) -> Column:
    return geom["type"].contains("Polygon")


def _covers(a: Column, p: Column) -> Column:
    return (locate(a["e"], p["x"], p["y"]) > 0) | _along(a, p)


def _contains(a: Column, p: Column) -> Column:
    return (locate(a["e"], p["x"], p["y"]) == 1) & ~_along(a, p)


def _on(a: Column, p: Column) -> Column:
    return F.exists(a["e"], lambda e: on_edge(e, p["x"], p["y"]))


def _middle(a: Column) -> Column:
    """An interior point of a polygon: in the first inside span of a line between its two lowest vertex heights."""
    heights = F.array_sort(F.array_distinct(F.transform(a["v"], lambda p: p["y"])))
    level = (F.get(heights, F.lit(0)) + F.get(heights, F.lit(1))) / 2

    def span(y):
        met = F.filter(a["e"], lambda e: (e["p"]["y"] > y) != (e["q"]["y"] > y))
        xs = F.array_sort(F.transform(met, lambda e: e["p"]["x"] + (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"])
                                      / F.when(e["q"]["y"] != e["p"]["y"], e["q"]["y"] - e["p"]["y"]).otherwise(F.lit(1.0))))
        return F.transform(F.array(xs), lambda x: xy((F.get(x, F.lit(0)) + F.get(x, F.lit(1))) / 2, y))
    return F.get(F.flatten(F.transform(F.array(level), span)), F.lit(0))


def intersects(a: Column, b: Column) -> Column:
    """Predicates take prepared geometries; cheap tests come first."""
    return ((is_polygon(b) & F.exists(a["v"], lambda p: _covers(b, p)))
            | (is_polygon(a) & F.exists(b["v"], lambda p: _covers(a, p)))
            | _any_edge_pair(a, b, segments_touch)
            | (a["type"].contains("Point") & F.exists(a["v"], lambda p: _on(b, p)))
            | (b["type"].contains("Point") & F.exists(b["v"], lambda p: _on(a, p)))
            | F.arrays_overlap(a["v"], b["v"]))


def _interiors_meet(a: Column, b: Column) -> Column:
    both = is_polygon(a) & is_polygon(b)
    return (_any_edge_pair(a, b, segments_cross)
            | (both & F.coalesce(F.exists(F.array(_middle(a), _middle(b)), lambda p: _contains(a, p) & _contains(b, p)), F.lit(False)))
            | (is_polygon(b) & F.exists(_probe_points(a, b), lambda p: _contains(b, p)))
            | (is_polygon(a) & F.exists(_probe_points(b, a), lambda p: _contains(a, p))))


def within(a: Column, b: Column) -> Column:
    """All of a lies in b and the interiors meet."""
    return (~_any_edge_pair(a, b, segments_cross) & F.forall(_probe_points(a, b), lambda p: _covers(b, p))
            & _interiors_meet(a, b))


def touches(a: Column, b: Column) -> Column:
    return intersects(a, b) & ~_interiors_meet(a, b)


def crosses(a: Column, b: Column) -> Column:
    """Lines that cross, or a line partly inside and partly outside a polygon."""
    def leaves(line, poly):
        inside = F.exists(_probe_points(line, poly), lambda p: _contains(poly, p))
        outside = F.exists(_probe_points(line, poly), lambda p: ~_covers(poly, p))
        return _any_edge_pair(line, poly, segments_cross) | (inside & outside)
    line_a, line_b = a["type"].contains("Line"), b["type"].contains("Line")
    return (F.when(line_a & line_b, _any_edge_pair(a, b, segments_cross))
            .when(line_a & is_polygon(b), leaves(a, b))
            .when(line_b & is_polygon(a), leaves(b, a))
            .otherwise(F.lit(False)))


PREDICATES = {
    "intersects": intersects,
    "within": within,
    "contains": lambda a, b: within(b, a),
    "crosses": crosses,
    "touches": touches,
}


def point_segment_distance(x, y, px, py, qx, qy) -> Column:
    """Planar distance from a point to a segment."""
    dx, dy = qx - px, qy - py
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - px) * dx + (y - py) * dy)
                                       / F.when(len2 == 0, F.lit(1.0)).otherwise(len2))))
    return F.sqrt(F.pow(x - (px + t * dx), F.lit(2.0)) + F.pow(y - (py + t * dy), F.lit(2.0)))


def clip_halfplane(path: Column, ax, ay, bx, by, keep_left: bool = True) -> Column:
    """Part of an open vertex loop on one side of the directed line a→b."""
    sign = 1.0 if keep_left else -1.0
    sided = F.transform(path, lambda p: F.struct(
        p["x"].alias("x"), p["y"].alias("y"),
        (_cross(ax, ay, bx, by, p["x"], p["y"]) * F.lit(sign)).alias("s")))

    def joined(loop):
        none = F.array().cast(PATH_TYPE)

        def step(p, q):
            t = p["s"] / (p["s"] - q["s"])
            cut_at = xy(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
            end = xy(q["x"], q["y"])
            return (F.when(q["s"] >= 0, F.when((p["s"] < 0) & (q["s"] > 0), F.array(cut_at, end))
                           .otherwise(F.array(end)))
                    .otherwise(F.when(p["s"] > 0, F.array(cut_at)).otherwise(none)))
        turned = F.concat(F.slice(loop, 2, F.greatest(F.size(loop) - 1, F.lit(0))), F.slice(loop, 1, 1))
        return F.flatten(F.zip_with(loop, turned, step))
    # a one-element array binds the sides, so that they are computed once
    return F.flatten(F.transform(F.array(sided), joined))


def clip_convex(ring: Column, clip_ring: Column) -> Column:
    """Clip a closed ring by a convex counter-clockwise closed ring; result closed."""
    loop = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).cast(PATH_TYPE)
    out = F.aggregate(
        edges_of_path(clip_ring), loop,
        lambda acc, e: clip_halfplane(acc, e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]))
    return close_loop(out)


def close_loop(loop: Column) -> Column:
    return F.when(F.size(loop) >= 3, F.concat(loop, F.slice(loop, 1, 1))).otherwise(
        F.array().cast(PATH_TYPE))
