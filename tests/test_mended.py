"""Closed forms for answers that were wrong once: concave shapes, rims, rays, early stops."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from terralane.functions import geometry as G
from terralane.operators.aggregates import summarize
from terralane.operators.joins import select_by_location, spatial_join
from terralane.operators.network import cost_distance
from terralane.operators.nearest import knn_join
from terralane.operators.terrain import viewshed
from terralane.operators.text import split_sections
from terralane.sources.database import sql_query

U = [(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9), (0, 0)]
BAR = [(1, 5), (8, 5), (8, 6), (1, 6), (1, 5)]             # across the notch
LEG = [(1, 1), (2, 1), (2, 8), (1, 8), (1, 1)]             # inside the left leg
PLUG = [(3, 3), (6, 3), (6, 9), (3, 9), (3, 3)]            # fills the notch
LID = [(0, 9), (9, 9), (9, 10), (0, 10), (0, 9)]
SHELF = [(3, 4), (6, 4), (6, 8), (3, 8), (3, 4)]           # in the notch, against both legs


@pytest.fixture
def shapes(spark):
    def make(rows):
        df = spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in ring]]) for i, ring in rows],
                                   "id long, rings array<array<struct<x:double,y:double>>>")
        return G.with_bounds(df.select("id", G.geometry("Polygon", F.col("rings")).alias("geom")))
    return make


@pytest.mark.parametrize("predicate, ids", [
    ("within", {0, 2}), ("contains", {0}), ("touches", {3, 4, 5}), ("intersects", {0, 1, 2, 3, 4, 5}), ("crosses", set())])
def test_concave_polygons(shapes, predicate, ids):
    all_ = shapes(list(enumerate([U, BAR, LEG, PLUG, LID, SHELF])))
    pairs = spatial_join(all_, shapes([(0, U)]), predicate).collect()
    assert {r["id_target"] for r in pairs} == ids


def test_points_on_the_rim(spark, points, boxes):
    df = points([(0, 0), (1, 1), (2, 1), (5, 5)])
    for ref in (boxes([(0, 0, 2, 2)]), boxes([(0, 0, 2, 2)]).drop("geom")):
        got = {rel: {r["id"] for r in select_by_location(df, ref, rel).collect()} for rel in ("intersects", "within", "touches", "contains", "crosses")}
        assert got == {"intersects": {0, 1, 2}, "within": {1}, "touches": {0, 2}, "contains": set(), "crosses": set()}
    with pytest.raises(ValueError):
        select_by_location(df, ref, "nonsense")


def test_nothing_is_seen_behind_a_closed_wall(cells):
    n = 41
    near = lambda r, c: (r - 20) ** 2 + (c - 20) ** 2
    grid = [[100.0 if 4 <= near(r, c) <= 13 else 0.0 for c in range(n)] for r in range(n)]
    got = viewshed(cells(grid), 20, 20, line_of_sight=True).collect()
    assert not [r for r in got if r["visible"] and near(r["r"], r["c"]) > 13]
    assert all(r["visible"] for r in got if near(r["r"], r["c"]) < 4)
    flat = viewshed(cells([[0.0] * n for _ in range(n)]), 20, 20, line_of_sight=True)
    assert flat.filter("visible = 0").count() == 0


@pytest.mark.parametrize("tile", [4, 7])
def test_cost_distance_over_many_tiles(cells, tile):
    rng = random.Random(3)
    grid = [[float(rng.choice([1, 2, 9, 50])) for _ in range(21)] for _ in range(12)]
    grid[11][20] = 1e12                      # one far cell drowns small gains in a sum
    src = cells(grid).filter("r = 0 and c = 0")
    got = {(r["r"], r["c"]): r["dist"] for r in cost_distance(cells(grid), src, tile=tile).collect()}
    best, heap = {}, [(0.0, 0, 0)]
    while heap:
        d, r, c = heapq.heappop(heap)
        if (r, c) in best:
            continue
        best[r, c] = d
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                if (i or j) and 0 <= r + i < 12 and 0 <= c + j < 21:
                    heapq.heappush(heap, (d + (grid[r][c] + grid[r + i][c + j]) / 2 * (2 ** 0.5 if i and j else 1), r + i, c + j))
    assert got == pytest.approx(best)


def test_first_needs_an_order(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 2), ("a", 3, 9)], "g string, t int, v int")
    assert summarize(df, "g", {"v": "first"}, order="t").first()["v_first"] == 5
    with pytest.raises(ValueError):
        summarize(df, "g", {"v": "first"})


def test_sections_of_any_text(spark):
    df = spark.createDataFrame([(1, "s", "intro\u0001more\n# A\nbody\n## B\n"), (2, "s", "# Top\nx")], "doc_id long, source string, text string")
    got = sorted((r["doc_id"], r["section"], r["heading"], r["body"].strip()) for r in split_sections(df).collect())
    assert got == [(1, 0, "", "intro\u0001more"), (1, 1, "A", "body"), (1, 2, "B", ""), (2, 1, "Top", "x")]


def test_limits_need_an_order(spark):
    with pytest.raises(ValueError):
        sql_query(spark, "select * from {t}", 3, t=spark.range(9))
    assert [r[0] for r in sql_query(spark, "select * from {t}", 2, ("id",), t=spark.range(5000)).collect()] == [0, 1]
    assert sql_query(spark, "select * from {t}", t=spark.range(5000)).count() == 5000


def test_half_of_the_right_side_at_one_place(points):
    right = [(5.0, 5.0)] * 1500 + [(float(i % 50), float(i // 50)) for i in range(1500)]
    got = knn_join(points([(5.1, 5.0), (49.0, 29.0)]), points(right), 2).collect()
    assert sorted((r["a_id"], r["rank"], r["b_id"]) for r in got)[:2] == [(0, 1, 0), (0, 2, 1)]
