"""Features that lie in many layers: worked on by themselves, in tiles that hold each a few times, and merged a few at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralane.functions import arrangement as A
from terralane.functions import geometry as G
from terralane.operators import shapes as S
from terralane.operators import siting


def ring(x, y, w, h):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]


def layer(spark, boxes):
    rows = [(i, {"type": "Polygon", "rings": [ring(*b)]}) for i, b in enumerate(boxes)]
    return G.with_bounds(spark.createDataFrame(rows, f"id long, geom {G.GEOM_TYPE}"))


@pytest.fixture
def stacked(spark):
    rng = np.random.default_rng(5)
    return layer(spark, [(*rng.uniform(0, 12, 2), 6, 5) for _ in range(300)])


def tiles_refused(*_, **__):
    raise AssertionError("cut up without need")


def test_small_features_are_not_cut_up(spark, stacked, monkeypatch):
    zones = layer(spark, [(0, 0, 9, 20), (9, 0, 11, 20)])
    monkeypatch.setattr(S, "_rings_of", tiles_refused)
    met = S.overlay_shapes(stacked, zones, "intersection").agg(F.sum("area")).first()[0]
    assert met == pytest.approx(300 * 30)
    area = S.buffer_shapes(stacked, 0.5, segments=8).agg(F.min("area"), F.max("area")).first()
    assert area[0] == pytest.approx(area[1]) and area[0] == pytest.approx(30 + 11 + 8 * 0.125 * np.sin(np.pi / 4))


@pytest.mark.parametrize("how", ["identity", "symmetric_difference"])
def test_alone_as_in_tiles(spark, stacked, how):
    zones = layer(spark, [(1, 1, 5, 18), (8.5, 2, 3, 4), (30, 30, 2, 2)])
    shown = lambda df: sorted((r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, round(r[2], 6)) for r in df.select("a_id", "b_id", "area").collect())
    assert shown(S.overlay_shapes(stacked, zones, how)) == shown(S.overlay_shapes(stacked, zones, how, tile=4.0))


def test_tiles_hold_a_feature_a_few_times(stacked):
    grid = S.Grid(stacked, None)
    dealt = S._dealt(stacked.select(F.lit(0).alias("layer"), F.col("id").cast("string").alias("id"), "geom"), grid, S._same)
    assert dealt.count() <= 6 * 300


def test_merged_is_the_outline():
    rng = np.random.default_rng(2)
    rings = [A.snap(np.array([[p["x"], p["y"]] for p in ring(*rng.uniform(0, 9, 2), *rng.uniform(1, 4, 2))])) for _ in range(400)]
    edges = [np.hstack([r[:-1], r[1:]]) for r in rings]
    whole, part = np.concatenate(edges), np.repeat(np.arange(400), 4)
    area = lambda e: float((e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]).sum() / 2)
    once, _, _ = S._outlines(whole, np.zeros(len(whole), np.int64))
    assert area(S._outlines(S._merged(whole, part), np.zeros(len(S._merged(whole, part)), np.int64))[0]) == pytest.approx(area(once), abs=1e-6)


def test_distance_to_boxes_walks_no_edges(spark, points):
    cells = points([(-1, 0.5), (2, 0.5), (2.5, 2.5), (0.5, 0.5)])
    near = siting.distance_to_layer(cells, layer(spark, [(0, 0, 1, 1)]), 2.0)
    assert {r[0]: round(r[1], 9) for r in near.collect()} == {0: 1.0, 1: 1.0, 3: 0.0}
