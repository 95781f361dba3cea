"""Overlay, dissolve and buffer polygons: closed forms, identities, points in and out, and every tile size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralane.functions import arrangement as A
from terralane.functions import geometry as G
from terralane.operators import shapes as S

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


def closed(points):
    return [*points, points[0]]


@pytest.fixture
def layer(spark):
    """id, grp, geom and bounds from {id: (type, rings)}; rings of plain points, open for lines."""
    def make(shapes, group=None):
        rows = [(i, None if group is None else group[i], {"type": kind, "rings": [[{"x": float(x), "y": float(y)} for x, y in (
            closed(r) if kind == "Polygon" else r)] for r in rings]}) for i, (kind, rings) in shapes.items()]
        df = spark.createDataFrame(rows, f"id long, grp string, geom {G.GEOM_TYPE}")
        return G.with_bounds(df)
    return make


def polygon(*rings):
    return "Polygon", rings


def shapes_of(df, *keys):
    return {tuple(r[k] for k in keys): (r["area"], [[(p["x"], p["y"]) for p in ring] for ring in r["geom"]["rings"]]) for r in df.collect()}


def inside(rings, x, y):
    wind = np.zeros(len(x), int)
    for ring in rings:
        r = np.array(ring, float)
        for (px, py), (qx, qy) in zip(r[:-1], r[1:]):
            side = (qx - px) * (y - py) - (x - px) * (qy - py)
            wind += ((py <= y) & (qy > y) & (side > 0)).astype(int) - ((py > y) & (qy <= y) & (side < 0)).astype(int)
    return wind


def star(rng, x, y, r):
    n = int(rng.integers(4, 11))
    angle = (np.arange(n) + rng.uniform(0, 0.9, n)) * 2 * math.pi / n
    far = rng.uniform(0.3, 1, n) * r
    return list(zip((x + far * np.cos(angle)).tolist(), (y + far * np.sin(angle)).tolist()))


HOLED = polygon(SQUARE, [(1, 1), (1, 3), (3, 3), (3, 1)])


@pytest.mark.parametrize("tile", [None, 1.0, 64.0])
def test_holes_and_notches(layer, tile):
    """A holed square against an L that covers a corner of the hole; by hand."""
    a, b = layer({1: HOLED}), layer({7: polygon([(2, 2), (6, 2), (6, 3), (5, 3), (5, 6), (2, 6)])})
    got = {how: shapes_of(S.overlay_shapes(a, b, how, tile=tile), "a_id", "b_id") for how in S.OVERLAYS}
    inter = got["intersection"][1, 7]
    assert inter == (3.0, [[(2.0, 3.0), (3.0, 3.0), (3.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 3.0)]])
    assert got["difference"] == {(1, None): (9.0, got["difference"][1, None][1])}
    assert [len(r) for r in got["difference"][1, None][1]] == [11]
    assert got["identity"] == got["intersection"] | got["difference"]
    assert got["symmetric_difference"][None, 7][0] == 13.0 - 3.0
    assert got["union"] == got["symmetric_difference"] | got["intersection"]


@pytest.mark.parametrize("tile", [0.25, 2.0, None])
def test_random_shapes(layer, tile):
    rng = np.random.default_rng(5)
    one = {i: polygon(star(rng, *rng.uniform(0, 8, 2), rng.uniform(1, 4))) for i in range(5)}
    two = {i + 100: polygon(star(rng, *rng.uniform(0, 8, 2), rng.uniform(1, 4))) for i in range(5)}
    x, y = rng.uniform(-1, 10, (2, 1500))
    in_one, in_two = ({i: inside([closed(r) for r in s[1]], x, y) > 0 for i, s in d.items()} for d in (one, two))
    any_one, any_two = np.any(list(in_one.values()), axis=0), np.any(list(in_two.values()), axis=0)
    got = shapes_of(S.overlay_shapes(layer(one), layer(two), "union", tile=tile), "a_id", "b_id")
    want = {(i, j): p & q for i, p in in_one.items() for j, q in in_two.items()}
    want |= {(i, None): p & ~any_two for i, p in in_one.items()} | {(None, j): q & ~any_one for j, q in in_two.items()}
    assert set(got) <= set(want)
    for key, points in want.items():
        wind = inside(got[key][1], x, y) if key in got else np.zeros(len(x), int)
        assert set(wind) <= {0, 1} and (wind == points).all()
    for i, s in one.items():       # what is inside and what is outside add up
        area = sum(v[0] for k, v in got.items() if k == (i, None))
        whole = A.signed_area(np.array(closed(s[1][0])))
        overlapping = S.overlay_shapes(layer({i: s}), layer(two), "difference", tile=tile).collect()
        assert math.isclose(area, sum(r["area"] for r in overlapping), abs_tol=1e-7) and area <= whole + 1e-7


def test_dissolve(layer):
    """Groups with a hole, an island in it, edges shared in part, parts that touch at a corner, and a null group."""
    frame = [polygon([(0, 0), (5, 0), (5, 1), (0, 1)]), polygon([(0, 4), (5, 4), (5, 5), (0, 5)]), polygon([(0, 1), (1, 1), (1, 4), (0, 4)]),
             polygon([(4, 0.5), (5, 0.5), (5, 4.5), (4, 4.5)]), polygon([(2, 2), (3, 2), (3, 3), (2, 3)])]
    corner = [polygon(SQUARE), polygon([(4, 4), (5, 4), (5, 5), (4, 5)])]
    shapes = dict(enumerate([*frame, *corner, polygon([(9, 9), (10, 9), (10, 10), (9, 10)]), polygon([(9, 9), (9, 10), (10, 10), (10, 9)])]))
    group = {**{i: "frame" for i in range(5)}, 5: "corner", 6: "corner", 7: None, 8: None}
    for tile in (None, 1.0, 0.5):
        rows = {r["grp"]: r for r in S.dissolve_shapes(layer(shapes, group).withColumn("note", F.col("id") * 10), "grp", tile=tile).collect()}
        f = rows["frame"]
        assert (f["features"], f["note"], f["area"], f["perimeter"], f["geom"]["type"]) == (5, 0, 17.0, 36.0, "MultiPolygon")
        assert sorted(len(r) for r in f["geom"]["rings"]) == [5, 5, 5]
        assert (rows["corner"]["area"], rows["corner"]["perimeter"], len(rows["corner"]["geom"]["rings"])) == (17.0, 20.0, 2)
        assert (rows[None]["area"], rows[None]["perimeter"]) == (1.0, 4.0)     # one of the two is turned the wrong way
    whole = S.dissolve_shapes(layer(shapes, group)).collect()
    assert len(whole) == 1 and whole[0]["area"] == 26.0
    assert S.dissolve_shapes(layer(shapes, group).limit(0), "grp").count() == 0


def distance(x, y, path):
    p, q = np.array(path[:-1], float), np.array(path[1:], float)
    d = q - p
    t = np.clip(((x[:, None] - p[:, 0]) * d[:, 0] + (y[:, None] - p[:, 1]) * d[:, 1]) / (d ** 2).sum(axis=1), 0, 1)
    return np.hypot(x[:, None] - p[:, 0] - t * d[:, 0], y[:, None] - p[:, 1] - t * d[:, 1]).min(axis=1)


def test_buffers(layer):
    """Corners in and out, a line that crosses itself, a hole that closes and one that only shrinks, a point."""
    rng = np.random.default_rng(2)
    ring = star(rng, 3, 3, 3)
    line = [tuple(p) for p in rng.uniform(0, 8, (7, 2)).tolist()]
    shapes = {1: polygon(ring), 2: ("LineString", [line]), 3: HOLED, 4: ("Point", [[(20, 20)]]), 5: ("LineString", [[(0, 0), (3, 0), (0, 0)]])}
    x, y = rng.uniform(-2, 10, (2, 3000))
    for d, tile in ((0.3, None), (0.9, 1.0), (1.4, None)):
        got = shapes_of(S.buffer_shapes(layer(shapes), d, tile=tile), "id")
        hole = np.where(inside([closed(SQUARE)], x, y) > 0, 0, distance(x, y, closed(SQUARE)))
        hole = np.where(inside([closed([(1, 1), (3, 1), (3, 3), (1, 3)])], x, y) > 0, distance(x, y, closed([(1, 1), (3, 1), (3, 3), (1, 3)])), hole)
        star_far = np.where(inside([closed(ring)], x, y) > 0, 0, distance(x, y, closed(ring)))
        for i, far in ((1, star_far), (2, distance(x, y, line)), (3, hole), (5, distance(x, y, [(0, 0), (3, 0)]))):
            wind = inside(got[i,][1], x, y)
            sure = (far < d * math.cos(math.pi / 64) * 0.999) | (far > d * 1.001)
            assert set(wind) <= {0, 1} and ((wind > 0) == (far < d))[sure].all()
        gon = 32 * math.sin(2 * math.pi / 64) * d * d
        assert math.isclose(got[4,][0], gon, rel_tol=1e-7) and math.isclose(got[5,][0], 6 * d + gon, rel_tol=1e-7)
        assert len(got[3,][1]) == (2 if d < 1 else 1)
        assert math.isclose(got[3,][0], 16 + 16 * d + gon - max(0, 2 - 2 * d) ** 2, rel_tol=1e-7)
    both = S.buffer_shapes(layer(shapes), 0.3, dissolve=True).collect()
    assert len(both) == 1 and both[0]["geom"]["type"] == "MultiPolygon"
    with pytest.raises(ValueError, match="above 0"):
        S.buffer_shapes(layer(shapes), 0.0)


def test_skewed_layer_and_one_shape_over_all_tiles(layer):
    """One shape covers everything, hundreds of others lie in one corner; every piece is where it belongs."""
    rng = np.random.default_rng(9)
    small = {i + 1: polygon([(x, y), (x + 0.5, y), (x + 0.5, y + 0.5), (x, y + 0.5)]) for i, (x, y) in enumerate(rng.integers(0, 12, (300, 2)).tolist())}
    far = {900: polygon([(99, 99), (100, 99), (100, 100), (99, 100)])}
    big = layer({0: polygon([(-1, -1), (101, -1), (101, 101), (-1, 101)])})
    got = shapes_of(S.overlay_shapes(layer(small | far), big, "intersection", tile=2.0), "a_id", "b_id")
    assert len(got) == 301 and all(math.isclose(v[0], 1.0 if k[0] == 900 else 0.25) for k, v in got.items())
    rest = shapes_of(S.overlay_shapes(big, layer(small | far), "difference", tile=2.0), "a_id", "b_id")
    places = len({tuple(s[1][0][0]) for s in small.values()})
    assert math.isclose(rest[0, None][0], 102 * 102 - 1 - 0.25 * places) and len(rest[0, None][1]) == 2 + places
