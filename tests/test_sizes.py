"""Queries on sides that were once refused, broadcast whole or read by one task."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from terralane.functions import geometry as G
from terralane.operators import joins as J
from terralane.operators import network as N
from terralane.operators import siting as S
from terralane.operators.measures import centroids
from terralane.operators.overlay import buffer_cells
from terralane.operators.spatialstats import variogram
from terralane.plans.fixtures import Layers
from terralane.plans.layers import paths


def test_tables_in_one_piece_are_dealt_out(spark, tmp_path):
    spark.range(1000).selectExpr("id as p_partkey", "'b' as p_brand").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    fx = Layers(spark, str(tmp_path))
    assert fx.part.rdd.getNumPartitions() > 1
    assert sorted(r[0] for r in fx.part.collect()) == list(range(1000))
    # the finished geometry stands below the shuffle and is not built again above it
    assert centroids(paths(fx))._jdf.queryExecution().optimizedPlan().toString().count("2741") == 1


def test_matrix_of_many_landmarks(spark):
    marks = spark.range(10_300).selectExpr("id", "id * 1.0 as x", "0.0 as y")
    got = J.matrix_mean(J.distance_matrix(marks.filter("id < 3"), marks)).first()
    want = [j - i for i in range(3) for j in range(i + 1, 10_300)]
    assert got["pairs"] == len(want) and got["mean_distance"] == pytest.approx(sum(want) / len(want))


def test_exploded_sides_are_not_broadcast(spark, points):
    pairs = J.within_distance_join(points([(0, 0), (1, 1)]), points([(0, 0), (1, 0)]), 1.0, "euclidean")
    assert "Broadcast" not in pairs._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r["a_id"], r["b_id"]) for r in pairs.collect()) == [(0, 0), (0, 1), (1, 1)]


@pytest.mark.parametrize("block", [7, 16_384])
def test_summaries_of_near_points(spark, monkeypatch, block):
    monkeypatch.setattr(J, "NEAR_BLOCK", block)
    rng = random.Random(5)
    a = [(None if i == 3 else i, rng.random(), rng.random()) for i in range(60)]
    b = [(i, f"n{i}", *((0.5, 0.5) if i % 3 else (rng.random(), rng.random()))) for i in range(200)] + [(9, "again", 0.5, 0.5), (None, None, 0.4, 0.4)]
    left, right = spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "id long, name string, x double, y double")
    for by_distance in (True, False):
        got = {r["id"]: (r["n"], r["names"]) for r in J.near_summary(left, right, 0.2, "euclidean", 4, by_distance).collect()}
        want = {}
        for i, x, y in a:
            near = [(math.hypot(x - u, y - v), -1 if j is None else j, name or "") for j, name, u, v in b if math.hypot(x - u, y - v) <= 0.2]
            near.sort(key=lambda t: t if by_distance else t[1:])
            if near:
                want[i] = (len(near), [t[2] or None for t in near[:4]])
        assert got == want
    plan = S.impact_stats(left, right, 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan      # no pair becomes a row


@pytest.mark.parametrize("block", [5, 16_384])
def test_variogram_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(J, "NEAR_BLOCK", block)
    rng = random.Random(6)
    rows = [(i, rng.random(), rng.random(), None if i == 4 else rng.random()) for i in range(80)] + [(7, 0.3, 0.3, 2.0), (None, 0.5, 0.5, 1.0)]
    out = variogram(spark.createDataFrame(rows, "id long, x double, y double, v double"), "v", 0.05, 0.3)
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    known, bins = [r for r in rows if r[3] is not None and r[0] is not None], {}
    for (i, x, y, _), (j, u, w, v) in itertools.product(known, known):
        d = math.sqrt((x - u) * (x - u) + (y - w) * (y - w))
        if i < j and d <= 0.3:
            bins.setdefault(math.floor(d / 0.05), []).extend((d, (r[3] - v) ** 2) for r in known if r[0] == i)
    got = {r["bin"]: r for r in out.collect()}
    assert got.keys() == bins.keys()
    for k, pairs in bins.items():
        assert got[k]["pairs"] == len(pairs)
        assert got[k]["distance"] == pytest.approx(sum(p[0] for p in pairs) / len(pairs))
        assert got[k]["gamma"] == pytest.approx(sum(p[1] for p in pairs) / len(pairs) / 2)


def test_paths_search_only_near_nodes(spark, monkeypatch):
    chain = [(i, i + 1, 1.0) for i in range(400)] + [(0, 2, 2.5), (1, 3, 2.25)]
    edges = spark.createDataFrame(chain, "src long, dst long, length double")
    seen, relax = [], N.relax

    def watched(*args, **kwargs):
        out = relax(*args, **kwargs, block_nodes=50)
        seen.append(out.count())
        return out
    monkeypatch.setattr(N, "relax", watched)
    got = [(r["length"], r["path"]) for r in N.k_shortest_paths(edges, 0, 3, 3).orderBy("rank").collect()]
    assert got == [(3.0, [0, 1, 2, 3]), (3.25, [0, 1, 3]), (3.5, [0, 2, 3])]
    assert max(seen) < 100


def test_edges_of_buffers_once_a_feature(spark):
    line = F.array(G.xy(F.col("id"), 0.0), G.xy(F.col("id") + 5, 5.0))
    lines = G.with_bounds(spark.range(3).select("id", G.geometry("LineString", F.array(line)).alias("geom")))
    got = {(r["id"], r["cx"], r["cy"]) for r in buffer_cells(lines, 1.0, 1.0).collect()}
    want = set()
    for i in range(3):
        for cx, cy in itertools.product(range(-5, 15), range(-5, 15)):
            x, y = cx + 0.5 - i, cy + 0.5
            t = max(0.0, min(1.0, (x + y) / 10))
            if math.hypot(x - 5 * t, y - 5 * t) <= 1.0:
                want.add((i, cx, cy))
    assert got == want
