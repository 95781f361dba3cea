"""Work is dealt out by its amount: searches of neighbours and graphs give no task more for a larger input."""

import numpy as np
import pytest

from terralane.operators import nearest, network


def clustered(rng, n):
    """Half of the points in one spot of a millionth of the extent, one in ten on one place."""
    out = rng.random((n, 2))
    out[: n // 2] = 0.5 + out[: n // 2] * 1e-6
    out[: n // 10] = 0.25
    return out.tolist()


def brute(a, b, k):
    a, b = np.array(a), np.array(b)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    return {(i, int(j), r + 1) for i, row in enumerate(d) for r, j in enumerate(np.lexsort((np.arange(len(b)), row))[:k])}


@pytest.mark.parametrize("m, n", [(600, 40), (30, 3000), (500, 500), (300, 12)])
def test_neighbours_by_more_tasks(spark, points, monkeypatch, m, n):
    monkeypatch.setattr(nearest, "TASK_ROWS", 10, raising=False)
    monkeypatch.setattr(nearest, "AROUND", 8, raising=False)
    rng = np.random.default_rng(m)
    a, b = clustered(rng, m), clustered(rng, n)
    found = nearest.knn_join(points(a), points(b), 3)
    assert {(r["a_id"], r["b_id"], r["rank"]) for r in found.collect()} == brute(a, b, 3)
    if m > 100:     # merged by bytes these few rows would be one task
        assert found.rdd.getNumPartitions() >= m / 10


def test_cells_with_few_rows_are_not_divided(spark, points):
    """A dense spot makes the pyramid deep; lone points stay at the level where they are alone."""
    from pyspark.sql import functions as F
    rows = [(i / 10, 0.9) for i in range(10)] + [(0.5 + i * 1e-6, 0.5) for i in range(300)]
    df = points(rows).select(F.col("id").alias("bid"), F.col("x").alias("bx"), F.col("y").alias("by"),
                             F.floor(F.col("x") * 2**nearest.FINEST).cast("long").alias("ix"), F.floor(F.col("y") * 2**nearest.FINEST).cast("long").alias("iy"))
    leaf = {r["bid"]: r["leaf"] for r in nearest._undivided(df, len(rows), 20).collect()}
    assert {leaf[i] for i in range(10)} == {nearest.STEP} and {leaf[i] for i in range(20, 300)} <= set(range(14, 21, 2))


def road(spark, n):
    return spark.createDataFrame([(i, i + 1, 1.0 + i % 3) for i in range(n - 1)], "src long, dst long, length double")


@pytest.mark.parametrize("cutoff", [None, 9.0])
def test_sources_in_buckets(spark, monkeypatch, cutoff):
    """Blocks with many sources split them; the labels are those of one walk to either side."""
    monkeypatch.setattr(network, "BLOCK_LABELS", 40)
    n, step = 90, [1.0 + i % 3 for i in range(89)]
    sources = spark.createDataFrame([(1000 + i, i) for i in range(0, n, 5)], "source long, node long")
    got = network.relax(network.both_ways(road(spark, n)), sources, cutoff, block_nodes=20).collect()
    at = [sum(step[:i]) for i in range(n)]
    want = {(1000 + i, j): abs(at[i] - at[j]) for i in range(0, n, 5) for j in range(n) if cutoff is None or abs(at[i] - at[j]) <= cutoff}
    assert {(r["source"], r["node"]): r["dist"] for r in got} == want and len(got) == len(want)


def test_far_sources_split_no_block(spark, monkeypatch):
    """The number of buckets follows the sources that came to a block, not all of them."""
    monkeypatch.setattr(network, "BLOCK_LABELS", 40)
    shape = "block int, source long, node long, dist double, prev long"
    labels = spark.createDataFrame([(0, s, n, 1.0, None) for s in range(8) for n in range(3)] + [(7, s, 900, 1.0, None) for s in range(500)], shape)
    fresh = spark.createDataFrame([(0, 8, 4, 0.0, None), (3, 9, 70, 0.0, None)], shape)
    assert {r["block"]: r["_buckets"] for r in network._bucket_counts(labels, fresh, 20).collect()} == {0: 5, 3: 1}
