"""Voronoi polygons against cutting every cell by every other seed."""

import math

import numpy as np
import pytest

from terralane.operators import voronoi as V


def rings(df):
    return {r["id"]: (r["area"], [(p["x"], p["y"]) for p in r["geom"]["rings"][0]]) for r in df.collect()}


def plain(pts, box):
    square = V._whole_box(None, box)
    return {i: V.cut_cell(square, p, np.delete(pts, i, axis=0)) for i, p in enumerate(pts)}


def area(ring):
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


@pytest.mark.parametrize("kind", ["uniform", "clusters", "circle"])
def test_cells(points, kind):
    rng = np.random.default_rng(4)
    if kind == "uniform":
        pts = rng.uniform(0, 10, (150, 2))
    elif kind == "clusters":        # dense clusters beside wide gaps
        pts = np.concatenate([c + rng.normal(0, 0.01, (50, 2)) for c in ((1, 1), (9, 2), (5, 9))])
    else:                           # the middle seed is bounded by all others
        turn = np.linspace(0, 2 * math.pi, 61)[:-1]
        pts = np.concatenate([[(5, 5)], 5 + 3 * np.stack([np.cos(turn), np.sin(turn)], axis=1)])
    box = (-1.0, -1.0, 11.0, 11.0)
    got = rings(V.voronoi(points(pts.tolist()), box=box))
    want = plain(pts, box)
    assert set(got) == set(want) and math.isclose(sum(a for a, _ in got.values()), 144, rel_tol=1e-9)
    assert all(math.isclose(got[i][0], area(want[i]), rel_tol=1e-6, abs_tol=1e-9) for i in want)
    inner = 0
    for _, ring in got.values():     # every vertex inside the box has three nearest seeds
        for x, y in ring:
            d = np.sort(np.hypot(*(pts - (x, y)).T))
            if -1 < x < 11 and -1 < y < 11:
                inner += 1
                assert d[2] - d[0] <= 1e-6 * max(d[0], 1e-3)
    assert inner > 100


def test_ties_and_odd_seeds(spark, points):
    grid = [(x, y) for x in range(4) for y in range(4)]
    got = rings(V.voronoi(points(grid + [(0, 0), (3, 3)]), box=(-0.5, -0.5, 3.5, 3.5)))
    assert set(got) == set(range(16)) and all(math.isclose(a, 1.0) for a, _ in got.values())
    one = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 1.0), ("c", 50.0, 50.0)], "id string, x double, y double")
    assert set(rings(V.voronoi(one, box=(0, 0, 4, 4)))) == {"a"}
    assert V.voronoi(one.limit(0)).count() == 0
    with pytest.raises(ValueError, match="area"):
        V.voronoi(one, box=(0, 0, 0, 4))
