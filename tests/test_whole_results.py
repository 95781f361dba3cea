"""Inputs beyond what a fixed number of rules, facilities or rounds covered, against plain Python."""

import math
import random

import pytest

import __spark_entry__ as entry
from terralane.operators import raster as R
from terralane.operators import siting as S
from terralane.operators.nearest import knn_join


@pytest.mark.parametrize("closed", ["left", "right"])
def test_long_rule_table_with_overlaps(spark, closed):
    rng = random.Random(5)
    rules = [(float(lo), float(lo + rng.choice([-3, 0, 1, 7, 400])), float(i)) for i, lo in enumerate(rng.choices(range(5000), k=3000))]
    values = [None, math.nan, -1.0, math.inf, *(x / 2 for x in range(0, 11000, 7))]
    cells = spark.createDataFrame([(0, c, v) for c, v in enumerate(values)], "r int, c int, v double")

    def want(v):
        fits = [] if v is None else [val for lo, hi, val in rules if (lo < v <= hi if closed == "right" else lo <= v < hi)]
        return fits[-1] if fits else -9999.0
    assert {r["c"]: r["v"] for r in R.reclassify(cells, rules, closed).collect()} == {c: want(v) for c, v in enumerate(values)}


def test_reclassify_query_has_a_class_for_every_height(spark, tmp_path):
    keys = [0, 499, 600_000, 20_000_000]        # the last ones lie in rows 1200 and 40000: heights above 2000
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["r"] * 500 + r["c"]: r["v"] for r in entry.queries()["reclassify_long_table_r15"](spark, str(tmp_path)).collect()}
    assert got == {k: float((100 + 2 * (k // 500) + 0.5 * (k % 500) + k * 37 % 17) // 10) for k in keys}


def brute_access(demand, places, beta, least):
    total = sum(p for *_, p in demand)

    def one(x, y):
        far = [(math.hypot(x - u, y - v), p) for u, v, p in demand if math.hypot(x - u, y - v) > least]
        return sum(p / d ** beta for d, p in far) * total / len(places)
    return [one(x, y) for x, y in places]


@pytest.mark.parametrize("beta", [2.0, 1.5])
def test_gravity_in_parts(spark, points, monkeypatch, beta):
    monkeypatch.setattr(S, "FACILITY_PART", 7)
    monkeypatch.setattr(S, "KERNEL_PAIRS", 100)
    rng = random.Random(2)
    demand = [(rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(1, 5)) for _ in range(60)] + [(0.0, 0.0, 2.0)]
    places = [(60.0, 80.0), (0.0, 0.0)] + [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(20)]     # the first at the limit itself
    got = S.gravity_access(spark.createDataFrame(demand, "x double, y double, pop double"), points(places), "pop", beta).collect()
    want = brute_access(demand, places, beta, 100.0)
    assert {r["id"]: r["accessibility"] for r in got} == pytest.approx(dict(enumerate(want)))
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(range(len(want)), key=lambda i: -want[i])


def test_gravity_with_more_facilities_than_once_allowed(spark):
    n = 100_003
    places = spark.range(n).selectExpr("id", "cast(id as double) as x", "0.0d as y")
    got = S.gravity_access(spark.createDataFrame([(-500.0, 0.0, 3.0)], "x double, y double, pop double"), places, "pop")
    last = got.filter(f"id = {n - 1}").first()
    assert got.count() == n and last["rank"] == n and last["accessibility"] == pytest.approx(9.0 / (n + 499) ** 2 / n)


@pytest.mark.parametrize("listed", [100_000, 0])
def test_only_points_in_reach_are_searched_for(spark, points, monkeypatch, listed):
    monkeypatch.setattr(S, "REACH_LISTED", listed)
    searched = []

    def knn(a, b, *args, **kwargs):
        searched.append(a.count())
        return knn_join(a, b, *args, **kwargs)
    monkeypatch.setattr(S, "knn_join", knn)
    rng = random.Random(8)
    near = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(60)] + [(0.7, 0.0), (-0.7, 0.0), (0.0, 0.7)]     # the last at the limit itself
    far = [(1000.0 + i, -1000.0) for i in range(500)]
    layer = [(0.0, 0.0), (2.1, 2.1), (-2.0, 1.0)]
    want = {i for i, (x, y) in enumerate(near + far) if min(math.sqrt((x - u) ** 2 + (y - v) ** 2) for u, v in layer) <= 0.7}
    cells = points(near + far)
    assert {r["id"] for r in S.constrain_area(cells, {"shop": points(layer)}, [("shop", "distance<=0.7")]).collect()} == want
    assert searched[0] <= len(near)
    rest = S.constrain_area(cells, {"shop": points(layer), "spot": points([(0.0, 0.0)])}, [("spot", "distance>=0.5"), ("shop", "distance<=0.7")])
    assert {r["id"] for r in rest.collect()} == {i for i in want if math.hypot(*near[i]) >= 0.5}
