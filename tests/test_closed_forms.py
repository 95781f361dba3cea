"""Cases with results known by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralane.functions import crs as C
from terralane.functions import geometry as G
from terralane.operators import joins as J
from terralane.operators import measures as M
from terralane.operators import network as N
from terralane.operators import overlay as O
from terralane.operators import raster as R
from terralane.operators import spatialstats as S
from terralane.operators import terrain as T


def one(df):
    return df.collect()[0]


def test_unit_square(boxes):
    sq = boxes([(0, 0, 1, 1)])
    assert one(M.measure_area(sq, "sqdeg"))["area"] == pytest.approx(1.0)
    c = one(M.centroids(sq))
    assert (c["x"], c["y"]) == pytest.approx((0.5, 0.5))
    assert one(M.measure_length(sq, "deg"))["length"] == pytest.approx(4.0)


def test_two_boxes_overlay(boxes):
    a, b = boxes([(0, 0, 2, 2)]), boxes([(1, 1, 3, 3)])
    area = {how: one(O.overlay(a, b, how, 0.1).agg(F.count("*").alias("n")))["n"] * 0.01
            for how in O.OVERLAYS}
    assert area["intersection"] == pytest.approx(1)
    assert area["union"] == pytest.approx(7)
    assert area["difference"] == pytest.approx(3)
    assert area["symmetric_difference"] == pytest.approx(6)
    assert area["intersection"] + area["difference"] == pytest.approx(4)
    assert area["identity"] == pytest.approx(4)
    assert one(O.intersect_convex(a, b))["area"] == pytest.approx(1)


def test_convex_clip_of_a_hole(spark):
    """A 4 x 4 square with a 2 x 2 hole, clipped to its right half."""
    def path(pts):
        return [{"x": float(x), "y": float(y)} for x, y in pts]
    ring = path([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])
    hole = path([(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)])
    clip = path([(2, -1), (9, -1), (9, 9), (2, 9), (2, -1)])
    schema = f"id long, geom {G.GEOM_TYPE}"
    a = G.with_bounds(spark.createDataFrame([(1, {"type": "Polygon", "rings": [ring, hole]})], schema))
    b = G.with_bounds(spark.createDataFrame([(1, {"type": "Polygon", "rings": [clip]})], schema))
    assert one(O.intersect_convex(a, b))["area"] == pytest.approx(8 - 2)
    concave = path([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)])
    c = G.with_bounds(spark.createDataFrame([(1, {"type": "Polygon", "rings": [concave]})], schema))
    with pytest.raises(ValueError, match="not convex"):
        O.intersect_convex(a, c)


def test_haversine(spark):
    d = spark.range(1).select(G.haversine(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d"))
    assert one(d)["d"] == pytest.approx(111194.927, abs=1e-3)


def test_mercator(spark):
    x, y = C.to_mercator(F.lit(180.0), F.lit(0.0))
    r = one(spark.range(1).select(x.alias("x"), y.alias("y")))
    assert (r["x"], r["y"]) == pytest.approx((20037508.343, 0.0), abs=1e-3)


@pytest.mark.parametrize("lon,lat,zone", [(3.0, 60.0, 32), (5.0, 75.0, 31), (10.0, 78.0, 33), (34.0, 80.0, 37),
                                          (116.4, 39.9, 50), (179.9, 0.0, 60), (180.0, 0.0, 60)])
def test_utm_zone(spark, lon, lat, zone):
    assert one(spark.range(1).select(C.utm_zone(F.lit(lon), F.lit(lat)).alias("z")))["z"] == zone


def test_round_trips(spark, points):
    df = points([(116.4, 39.9), (100.0, 25.5), (121.47, 31.23), (-70.0, 10.0), (10.0, -33.0)])
    for epsg in (3857, 32650, 32750):
        near = df.filter("x > 110") if epsg > 4000 else df
        back = M.reproject_layer(M.reproject_layer(near, 4326, epsg), epsg, 4326).collect()
        for a, b in zip(near.collect(), back):
            assert (a["x"], a["y"]) == pytest.approx((b["x"], b["y"]), abs=1e-8)
    for name in ("gcj02", "bd09"):
        back = M.convert_datum(M.convert_datum(df, "wgs84", name), name, "wgs84").collect()
        for a, b in zip(df.filter("x > 90").collect(), [r for r in back if r["x"] > 90]):
            assert (a["x"], a["y"]) == pytest.approx((b["x"], b["y"]), abs=1e-5)
    moved = {r["id"]: r for r in M.convert_datum(df, "wgs84", "gcj02").collect()}
    assert (moved[3]["x"], moved[3]["y"]) == (-70.0, 10.0)
    assert 0.001 < abs(moved[0]["x"] - 116.4) < 0.01


def test_known_utm_point(points):
    r = one(M.reproject_layer(points([(117.0, 0.0)]), 4326, 32650))
    assert (r["x"], r["y"]) == pytest.approx((500000.0, 0.0), abs=1e-6)
    r = one(M.reproject_to_utm(points([(3.0, 45.0)])))
    assert (r["x"], r["y"]) == pytest.approx((500000.0, 4982950.400), abs=1e-2)


def test_plane_slope(cells):
    plane = cells([[3.0 * c for c in range(6)] for _ in range(5)])
    assert {round(r["slope"], 3) for r in T.slope(plane).collect()} == {71.565}
    assert {round(r["slope"], 6) for r in T.slope(plane, unit="percent").collect()} == {300.0}


def test_flow_to_the_east(cells):
    plane = cells([[-float(c) for c in range(6)] for _ in range(5)])
    got = {(r["r"], r["c"]): r["dir"] for r in T.flow_direction(plane).collect()}
    for (r, c), code in got.items():
        assert code == (4 if 0 < r < 4 and 0 < c < 5 else 0)


def test_idw_on_a_sample(points):
    pts = points([(0, 0), (1, 0), (0, 1), (1, 1)]).withColumn("v", F.col("id") * 10.0)
    grid = {"x0": 0.0, "y0": 0.0, "dx": 1.0, "dy": 1.0, "rows": 2, "cols": 2}
    for k in (None, 4):
        got = {(r["r"], r["c"]): r["v"] for r in S.idw(pts, "v", grid, k=k).collect()}
        assert [got[0, 0], got[0, 1], got[1, 0], got[1, 1]] == pytest.approx([0, 10, 20, 30], abs=1e-6)


def test_checkerboard_moran(boxes):
    board = boxes([(i, j, i + 1, j + 1) for i in range(4) for j in range(4)])
    board = board.withColumn("v", F.when((F.col("minx") + F.col("miny")) % 2 == 0, 1.0).otherwise(-1.0))
    got = one(S.morans_i(board, "v", J.contiguity(board, "rook")))
    assert got["moran_i"] == pytest.approx(-1.0)
    assert got["expected_i"] == pytest.approx(-1 / 15)
    assert got["z_score"] < 0 and got["p_value"] < 0.01


def test_two_ways_to_the_end(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0)], "src long, dst long, length double")
    path = N.shortest_path(edges, 0, 2).orderBy("seq").collect()
    assert [r["node"] for r in path] == [0, 1, 2] and path[-1]["dist"] == 2.0
    two = N.k_shortest_paths(edges, 0, 2, 2).orderBy("rank").collect()
    assert [(r["length"], r["path"]) for r in two] == [(2.0, [0, 1, 2]), (3.0, [0, 2])]
    assert N.shortest_path(edges, 0, 99).count() == 0
    assert N.k_shortest_paths(edges, 0, 99, 2).count() == 0


def test_predicates(boxes):
    a = boxes([(0, 0, 2, 2)])
    cases = {"intersects": [1, 1, 1, 0, 1], "within": [0, 0, 0, 0, 1], "contains": [0, 1, 0, 0, 0],
             "touches": [0, 0, 1, 0, 0]}
    others = boxes([(1, 1, 3, 3), (0.5, 0.5, 1, 1), (2, 0, 4, 2), (5, 5, 6, 6), (-1, -1, 3, 3)])
    tilted = others.withColumn("geom", G.geometry("Polygon", F.array(F.concat(
        F.slice(F.col("geom.rings")[0], 1, 1), F.array(G.xy((F.col("minx") + F.col("maxx")) / 2, F.col("miny"))),
        F.slice(F.col("geom.rings")[0], 2, 4)))))       # the same shape with a sixth vertex
    for name, want in cases.items():
        for layer in (others, tilted):
            got = {r["id_join"] for r in J.spatial_join(a, layer, name).collect()}
            assert got == {i for i, w in enumerate(want) if w}, name


def test_lines_cross_polygons(spark, boxes):
    box = boxes([(0, 0, 2, 2)])
    rows = [(0, [(-1, 1), (3, 1)]), (1, [(0.5, 0.5), (1, 1)]), (2, [(5, 5), (6, 6)]), (3, [(0.5, 0.5), (5, 0.5)])]
    lines = spark.createDataFrame(
        [(i, {"type": "LineString", "rings": [[{"x": float(x), "y": float(y)} for x, y in p]]}) for i, p in rows],
        f"id long, geom {G.GEOM_TYPE}")
    lines = G.with_bounds(lines)
    got = {r["id_target"] for r in J.spatial_join(lines, box, "crosses").collect()}
    assert got == {0, 3}
    assert {r["id_target"] for r in J.spatial_join(lines, box, "within").collect()} == {1}


def test_simplify_keeps_ends_and_rings(spark):
    line = [{"x": float(i), "y": 0.0 if i % 2 else 0.01} for i in range(11)]
    spike = [{"x": 0.0, "y": 0.0}, {"x": 5.0, "y": 3.0}, {"x": 10.0, "y": 0.0}]
    df = spark.createDataFrame([(1, {"type": "LineString", "rings": [line]}), (2, {"type": "LineString", "rings": [spike]})],
                               f"id long, geom {G.GEOM_TYPE}")
    got = {r["id"]: r["vertices_after"] for r in M.simplify_layer(df, 0.1).collect()}
    assert got == {1: 2, 2: 3}


def test_sun_at_solstice(spark):
    import datetime as dt
    az, alt = T.sun_angles_at(spark, dt.datetime(2024, 6, 20, 12, 2), 51.4779, 0.0)
    assert alt == pytest.approx(61.96, abs=0.1) and az == pytest.approx(180, abs=1.0)
    with pytest.raises(ValueError, match="below the horizon"):
        T.terrain_shadow(spark.createDataFrame([(0, 0, 1.0)], "r int, c int, v double"), dt.datetime(2024, 6, 20, 0, 0), 40.0, 0.0)


def test_line_of_sight_behind_a_wall(cells):
    row = [0.0, 0.0, 5.0, 0.0, 6.0, 40.0]
    got = {r["c"]: r["visible"] for r in T.viewshed(cells([row]), 0, 0, height=1.0, line_of_sight=True).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 1}


def test_band_formula_is_checked(cells):
    df = cells([[1.0, 2.0]]).withColumn("band", F.lit(1))
    got = sorted(r["v"] for r in R.band_math(df, "1 / (b1 - 1)").collect())
    assert got == [0.0, 1.0]
    for bad in ("__import__('os')", "b1.real", "x + 1", "open(b1)"):
        with pytest.raises(ValueError):
            R.band_math(df, bad)


def test_kriging_is_exact_at_samples(points):
    rng = np.random.default_rng(3)
    pts = points(rng.random((40, 2)).tolist()).withColumn("v", F.sin("x") * 10 + F.col("y"))
    rows = pts.orderBy("id").limit(1).collect()[0]
    grid = {"x0": rows["x"], "y0": rows["y"], "dx": 1.0, "dy": 1.0, "rows": 1, "cols": 1}
    got = one(S.local_kriging(pts, "v", grid, "linear", 8, sill=2.0, rng=1.0))
    assert got["v"] == pytest.approx(rows["v"]) and got["variance"] == pytest.approx(0.0, abs=1e-9)


def test_kde_integrates_to_one(points):
    rng = np.random.default_rng(5)
    pts = points(rng.normal(size=(200, 2)).tolist())
    grid = {"x0": -8.0, "y0": -8.0, "dx": 0.1, "dy": 0.1, "rows": 161, "cols": 161}
    total = S.kde(pts, grid, 0.5).agg(F.sum("density")).first()[0] * 0.01
    assert total == pytest.approx(1.0, abs=1e-3)


def test_hull_of_degenerate_layers(points):
    line = one(O.convex_hull(points([(0, 0), (1, 1), (2, 2)])))
    assert line["geom"]["type"] == "LineString"
    dot = one(O.convex_hull(points([(3, 4), (3, 4)])))
    assert dot["geom"]["type"] == "Point"
    square = one(O.convex_hull(points([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)])))
    assert len(square["geom"]["rings"][0]) == 5


def test_haversine_is_symmetric_over_the_date_line(points):
    a, b = points([(179.99, 0.0)]), points([(-179.99, 0.0), (0.0, 0.0)])
    got = J.within_distance_join(a, b, 5000.0).collect()
    assert [(r["a_id"], r["b_id"]) for r in got] == [(0, 0)]
    assert got[0]["dist"] == pytest.approx(2 * 0.01 * math.pi / 180 * G.EARTH_RADIUS, rel=1e-6)
