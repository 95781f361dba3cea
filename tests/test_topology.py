"""Simplification with shared borders: no gaps, no crossings, deviations within the tolerance."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralane.functions import arrangement as A
from terralane.functions import geometry as G
from terralane.operators import shapes as S
from terralane.operators import topology as T


def wiggle(rng, p, q, n, size):
    """A border from p to q with n inner vertices."""
    p, q = np.array(p, float), np.array(q, float)
    t = np.sort(rng.uniform(0, 1, n))[:, None]
    d = q - p
    normal = np.array([-d[1], d[0]]) / math.hypot(*d)
    inner = p + t * d + rng.uniform(-size, size, n)[:, None] * np.minimum(t, 1 - t) * 2 * normal
    return [tuple(x) for x in A.snap(np.concatenate([[p], inner, [q]])).tolist()]


def quilt(rng, cells, n, size):
    """cells x cells polygons whose borders are wiggly and shared."""
    edge = {}
    for i, j in itertools.product(range(cells + 1), repeat=2):
        for k, (a, b) in enumerate((((i, j), (i + 1, j)), ((i, j), (i, j + 1)))):
            if max(b) <= cells:
                edge[a, b] = wiggle(rng, a, b, n, size)
    out = {}
    for i, j in itertools.product(range(cells), repeat=2):
        a, b, c, d = (i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)
        out[i * cells + j] = edge[a, b] + edge[b, c][1:] + edge[d, c][::-1][1:] + edge[a, d][::-1][1:]
    return out


def layer(spark, shapes):
    rows = [(i, {"type": kind, "rings": [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]}) for i, (kind, rings) in shapes.items()]
    return G.with_bounds(spark.createDataFrame(rows, f"id long, geom {G.GEOM_TYPE}"))


def rings_of(df):
    return {r["id"]: [[(p["x"], p["y"]) for p in ring] for ring in r["geom"]["rings"]] for r in df.collect()}


def crossings(segments):
    """Pairs of segments that meet other than at a shared end."""
    found = 0
    for (a, b), (c, d) in itertools.combinations(segments, 2):
        if {a, b} & {c, d}:
            continue
        o = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        found += o(a, b, c) * o(a, b, d) < 0 and o(c, d, a) * o(c, d, b) < 0
    return found


@pytest.mark.parametrize("tol", [0.05, 0.3, 10.0])
def test_quilt_stays_whole(spark, tol):
    rng = np.random.default_rng(int(tol * 100))
    shapes = {i: ("Polygon", [ring]) for i, ring in quilt(rng, 3, 12, 0.2).items()}
    out = T.simplify_topology(layer(spark, shapes), tol)
    got = rings_of(out)
    count = {r["id"]: (r["vertices_before"], r["vertices_after"]) for r in out.collect()}
    assert set(got) == set(shapes) and all(count[i][0] == len(shapes[i][1][0]) and count[i][1] == len(got[i][0]) for i in shapes)
    assert sum(a for _, a in count.values()) < 0.8 * sum(b for b, _ in count.values())
    edges = [tuple(sorted(e)) for rings in got.values() for r in rings for e in zip(r[:-1], r[1:])]
    outer = {e for e in edges if edges.count(e) == 1}
    assert all(edges.count(e) <= 2 for e in edges)
    segments = set(edges)
    assert crossings(segments) == 0
    # borders are shared in full: the whole has one outline, made of the edges that one shape has
    whole = S.dissolve_shapes(G.with_bounds(out)).first()
    assert len(whole["geom"]["rings"]) == 1
    areas = [A.signed_area(np.array(r[0])) for r in got.values()]
    assert min(areas) > 0 and math.isclose(sum(areas), whole["area"], rel_tol=1e-9)
    assert math.isclose(whole["perimeter"], sum(math.dist(*e) for e in outer), rel_tol=1e-6)
    for i, rings in got.items():
        r = np.array(rings[0])
        kept = set(rings[0])
        for p in shapes[i][1][0]:
            if p not in kept:
                d = r[1:] - r[:-1]
                t = np.clip(((np.array(p) - r[:-1]) * d).sum(axis=1) / (d ** 2).sum(axis=1), 0, 1)
                assert np.hypot(*(np.array(p) - r[:-1] - t[:, None] * d).T).min() <= tol + 1e-12


def test_islands_lines_and_odd_shapes(spark):
    """A hole that another polygon fills, lines that meet, a point in a bay that must stay outside, nulls."""
    rng = np.random.default_rng(3)
    angle = np.linspace(0, 2 * math.pi, 41)[:-1]
    blob = [tuple(p) for p in A.snap(np.stack([5 + (2 + 0.1 * rng.random(40)) * np.cos(angle), 5 + (2 + 0.1 * rng.random(40)) * np.sin(angle)], axis=1)).tolist()]
    turned = blob[7:] + blob[:7]
    box = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    bay = [(20, 0), (22, 0.2), (24, 0), (24, 4), (20, 4), (20, 0)]
    shapes = {1: ("Polygon", [box, [*blob[::-1], blob[-1]]]), 2: ("Polygon", [[*turned, turned[0]]]), 3: ("LineString", [wiggle(rng, (30, 0), (40, 0), 30, 0.4)]),
              4: ("LineString", [wiggle(rng, (40, 0), (40, 9), 30, 0.4)]), 5: ("Polygon", [bay]), 6: ("Point", [[(22, 0.1)]])}
    df = layer(spark, shapes)
    df = df.unionByName(df.limit(1).select(F.lit(7).cast("long").alias("id"), F.lit(None).cast(G.GEOM_TYPE).alias("geom"), "minx", "miny", "maxx", "maxy"))
    out = T.simplify_topology(df, 0.5)
    rows = {r["id"]: r for r in out.collect()}
    assert rows[7]["geom"] is None and len(rows) == 7
    got = rings_of(out.filter("geom is not null"))
    hole, island = got[1][1], got[2][0]
    assert len(island) < 20 and {frozenset(e) for e in zip(hole[:-1], hole[1:])} == {frozenset(e) for e in zip(island[:-1], island[1:])}
    assert got[1][0] == [tuple(map(float, p)) for p in box]
    assert got[3][0][0] == (30, 0) and got[3][0][-1] == got[4][0][0] == (40, 0) and len(got[3][0]) < 10
    assert got[6] == [[(22.0, 0.1)]]
    again = rings_of(T.simplify_topology(layer(spark, {5: shapes[5]}), 0.5))
    assert (22.0, 0.2) in got[5][0]
    assert (22.0, 0.2) not in again[5][0]
    assert T.simplify_topology(df.limit(0), 1.0).count() == 0


def test_guard_points():
    """A removal that would sweep over a point is refused, also when the point lies on the new line."""
    arc = np.array([(0, 0), (2, 1), (4, 0)], float)
    assert T.simplified(arc, np.zeros((0, 2)), 5).tolist() == [0, 2]
    assert T.simplified(arc, np.array([(2, 0.5)]), 5).tolist() == [0, 1, 2]
    assert T.simplified(arc, np.array([(2, 0.0)]), 5).tolist() == [0, 1, 2]
    assert T.simplified(arc, np.array([(2, 1.5), (2, -0.1)]), 5).tolist() == [0, 2]
    assert T.simplified(arc, np.zeros((0, 2)), 0.5).tolist() == [0, 1, 2]
