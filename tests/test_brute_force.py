"""Random and skewed inputs against plain Python."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralane.operators import aggregates as A
from terralane.operators import hydrology as H
from terralane.operators import joins as J
from terralane.operators import network as N
from terralane.operators import terrain as T
from terralane.operators.nearest import knn_join
from terralane.operators.quantiles import exact_quantiles


def skewed(rng, n):
    """A third of the points share one coordinate, a third sit in a tiny cluster."""
    pts = rng.random((n, 2)) * 100
    pts[: n // 3] = (42.0, 17.0)
    pts[n // 3: 2 * n // 3] = (70, 30) + rng.random((n // 3, 2)) * 1e-6
    return [tuple(p) for p in pts[rng.permutation(n)].tolist()]


def brute_knn(a, b, k, limit=math.inf):
    out = set()
    for i, (x, y) in enumerate(a):
        ds = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, (u, v) in enumerate(b))
        out |= {(i, j, r) for r, (d, j) in enumerate(ds[:k], start=1) if d <= limit}
    return out


@pytest.mark.parametrize("k,limit", [(1, None), (5, None), (3, 6.0)])
def test_knn_with_skew(points, k, limit):
    rng = np.random.default_rng(7)
    a, b = skewed(rng, 90), skewed(rng, 1500)
    got = knn_join(points(a), points(b), k, limit).collect()
    assert {(r["a_id"], r["b_id"], r["rank"]) for r in got} == brute_knn(a, b, k, limit or math.inf)


def test_knn_haversine_world(points):
    rng = np.random.default_rng(11)
    def sphere(n):
        return list(zip((rng.random(n) * 360 - 180).tolist(), np.degrees(np.arcsin(rng.random(n) * 2 - 1)).tolist()))
    a, b = sphere(150) + [(179.999, 0.0), (0.0, 90.0), (-180.0, -89.9)], sphere(400) + [(-179.999, 0.01)]

    def hav(p, q):
        x1, y1, x2, y2 = map(math.radians, (*p, *q))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, h)))
    want = {i: min((hav(p, q), j) for j, q in enumerate(b))[1] for i, p in enumerate(a)}
    got = {r["a_id"]: r["b_id"] for r in knn_join(points(a), points(b), 1, metric="haversine").collect()}
    assert got == want


def test_knn_edges(points):
    few = points([(0, 0), (1, 0)])
    assert knn_join(points([(0, 0)]), few, 5).count() == 2
    assert knn_join(points([]), few, 1).count() == 0
    assert knn_join(few, points([]), 1).count() == 0
    assert knn_join(few, points([]), 1).count() == 0
    both = knn_join(few, few, 1, exclude_self=True).collect()
    assert {(r["a_id"], r["b_id"]) for r in both} == {(0, 1), (1, 0)}
    with pytest.raises(ValueError, match="available"):
        knn_join(few, few.drop("x"), 1)


def test_within_distance_skew(points):
    rng = np.random.default_rng(13)
    a, b = skewed(rng, 120), skewed(rng, 150)
    got = {(r["a_id"], r["b_id"]) for r in J.within_distance_join(points(a), points(b), 3.0, "euclidean").collect()}
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if math.dist(p, q) <= 3.0}
    assert got == want


def test_bbox_pairs_of_all_sizes(boxes):
    rng = np.random.default_rng(17)
    def make(n):
        rows = []
        for _ in range(n):
            x, y = rng.random(2) * 100 - 50
            w, h = 10 ** rng.uniform(-3, 2, 2)
            rows.append((x, y, x + w, y + h))
        return rows + [(-1e4, -1e4, 1e4, 1e4), (0, 0, 0, 0), (0, 0, 64, 64), (64, 64, 128, 128)]
    a, b = make(60), make(70)
    got = [(r["a_id"], r["b_id"]) for r in J.bbox_pairs(boxes(a), boxes(b)).select("a_id", "b_id").collect()]
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b)
            if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("seed", range(3))
def test_quantiles(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([np.full(300, 1.5), rng.lognormal(0, 5, 400), [1e18, -1e18]])
    probs = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(values)] + [(1, None), (1, float("nan"))], "g int, v double")
    assert list(exact_quantiles(df, "v", probs).first()) == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))] for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(np.quantile(values[g::3], probs).tolist(), rel=1e-12)


def test_natural_breaks(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 50, 51, 52, 100, 101]], "v double")
    assert A.class_breaks(df, "v", 3, "natural") == [1.0, 3.0, 52.0, 101.0]


def lattice(rows, cols, rng):
    out = []
    for r in range(rows):
        for c in range(cols):
            n = r * cols + c
            if c + 1 < cols:
                out.append((n, n + 1, float(rng.integers(1, 20))))
            if r + 1 < rows:
                out.append((n, n + cols, float(rng.integers(1, 20))))
    return out


def dijkstra(edges, start, directed=False):
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
        if not directed:
            adj.setdefault(b, []).append((a, w))
    dist, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if d > dist[n]:
            continue
        for m, w in adj.get(n, []):
            if d + w < dist.get(m, math.inf):
                dist[m] = d + w
                heapq.heappush(heap, (d + w, m))
    return dist


@pytest.fixture(scope="module")
def town(spark):
    edges = lattice(9, 11, np.random.default_rng(23))
    return edges, spark.createDataFrame(edges, "src long, dst long, length double")


@pytest.mark.parametrize("block_nodes", [12, 4096])
def test_relax_over_blocks(spark, town, block_nodes):
    edges, df = town
    sources = spark.createDataFrame([(7, 0), (8, 50)], "source long, node long")
    got = {(r["source"], r["node"]): r["dist"] for r in N.relax(N.both_ways(df), sources, block_nodes=block_nodes).collect()}
    want = {(s, n): d for s, start in ((7, 0), (8, 50)) for n, d in dijkstra(edges, start).items()}
    assert got == want
    near = N.relax(N.both_ways(df), sources, cutoff=30.0, block_nodes=block_nodes).collect()
    assert {(r["source"], r["node"]) for r in near} == {k for k, d in want.items() if d <= 30.0}


def test_relax_by_edges_when_a_block_is_heavy(spark, town, monkeypatch):
    edges, df = town
    monkeypatch.setattr(N, "BLOCK_ARCS", 10)
    sources = spark.createDataFrame([(7, 3)], "source long, node long")
    got = {r["node"]: r["dist"] for r in N.relax(N.both_ways(df), sources).collect()}
    assert got == dijkstra(edges, 3)


@pytest.mark.parametrize("block_nodes", [15, 4096])
def test_nearest_facilities_keep_n(spark, town, block_nodes):
    edges, df = town
    homes = [0, 5, 33, 47, 98]
    sources = spark.createDataFrame([(100 + h, h) for h in homes], "source long, node long")
    got = {(r["source"], r["node"]): r["dist"]
           for r in N.relax(N.both_ways(df), sources, keep=2, block_nodes=block_nodes).collect()}
    all_d = {h: dijkstra(edges, h) for h in homes}
    for node in range(99):
        want = sorted((all_d[h][node], 100 + h) for h in homes)[:2]
        mine = sorted((d, s) for (s, n), d in got.items() if n == node)
        assert [d for d, _ in mine] == [d for d, _ in want]


def test_directed_path_and_flow(spark, town):
    edges, df = town
    path = N.shortest_path(df, 0, 98, directed=True).orderBy("seq").collect()
    assert path[-1]["dist"] == dijkstra(edges, 0, directed=True)[98]
    steps = {(a, b): w for a, b, w in edges}
    assert sum(steps[a["node"], b["node"]] for a, b in zip(path, path[1:])) == path[-1]["dist"]
    origins = spark.createDataFrame([(0,), (50,)], "node long")
    ends = spark.createDataFrame([(98,), (7,), (7,)], "node long")
    flow = N.edge_flow(df, origins, ends).join(N.both_ways(df), ["src", "dst"])
    total = flow.agg(F.sum(F.col("flow") * F.col("w"))).first()[0]
    assert total == sum(dijkstra(edges, s)[t] for s in (0, 50) for t in (98, 7, 7))


def brute_simple_paths(edges, s, t, k):
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    out = []

    def go(path, length):
        if path[-1] == t:
            out.append((length, path))
            return
        for m, w in adj[path[-1]]:
            if m not in path:
                go(path + [m], length + w)
    go([s], 0.0)
    return sorted(out)[:k]


def test_k_paths(spark):
    edges = lattice(3, 4, np.random.default_rng(29))
    df = spark.createDataFrame(edges, "src long, dst long, length double")
    got = [(r["length"], r["path"]) for r in N.k_shortest_paths(df, 0, 11, 6).orderBy("rank").collect()]
    assert got == brute_simple_paths(edges, 0, 11, 6)


def test_cost_distance(spark, cells):
    rng = np.random.default_rng(31)
    grid = rng.integers(1, 9, (12, 15)).astype(float)
    grid[4, 2:12] = np.nan
    start = spark.createDataFrame([(0, 0), (11, 14)], "r int, c int")
    edges = []
    for r in range(12):
        for c in range(15):
            for i, j in ((0, 1), (1, 0), (1, 1), (1, -1)):
                r2, c2 = r + i, c + j
                if r2 < 12 and 0 <= c2 < 15 and not math.isnan(grid[r, c] + grid[r2, c2]):
                    step = math.sqrt(2) if i and j else 1.0
                    edges.append(((r, c), (r2, c2), (grid[r, c] + grid[r2, c2]) / 2 * step))
    a, b = dijkstra(edges, (0, 0)), dijkstra(edges, (11, 14))
    for tile in (5, 128):
        got = {(x["r"], x["c"]): x["dist"] for x in N.cost_distance(cells(grid.tolist()), start, tile=tile).collect()}
        for key, d in got.items():
            want = min(a.get(key, math.inf), b.get(key, math.inf))
            assert d is None if math.isinf(want) else d == pytest.approx(want)


def test_flow_and_watershed(cells):
    rng = np.random.default_rng(37)
    grid = np.add.outer(np.arange(14) * 2.0, np.arange(16)) + rng.random((14, 16)) * 5
    direction = T.flow_direction(cells(grid.tolist()))
    code = {(r["r"], r["c"]): r["dir"] for r in direction.collect()}
    step = {k: (i, j) for i, j, k in T.FLOW_CODES}
    acc = dict.fromkeys(code, 0)
    through = {k: set() for k in code}
    for cell in code:
        at = cell
        while at in code:
            acc[at] += 1
            through[at].add(cell)
            if code[at] == 0:
                break
            at = (at[0] + step[code[at]][0], at[1] + step[code[at]][1])
    got = {(r["r"], r["c"]): r["acc"] for r in H.flow_accumulation(direction).collect()}
    assert got == acc
    pour = max(acc, key=lambda k: acc[k])
    assert {(r["r"], r["c"]) for r in H.watershed(direction, *pour).collect()} == through[pour]


def test_flow_cycle_is_reported(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_ROUNDS", 3)
    loop = spark.createDataFrame([(0, 0, 4), (0, 1, 64)], "r int, c int, dir int")
    with pytest.raises(RuntimeError, match="cycle"):
        H.flow_accumulation(loop)


def parts_of(cells_set):
    left, out = set(cells_set), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            part.add((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(frozenset(part))
    return set(out)


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_cell_components(spark, tile):
    rng = np.random.default_rng(41)
    chosen = [(r, c) for r in range(20) for c in range(22) if rng.random() < 0.55]
    df = spark.createDataFrame(chosen, "r int, c int")
    got = {}
    for r in H.cell_components(df, tile=tile).collect():
        got.setdefault(r["component"], set()).add((r["r"], r["c"]))
    assert {frozenset(p) for p in got.values()} == parts_of(chosen)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    nodes = spark.createDataFrame([(i,) for i in [*range(301), *range(1000, 1200), 5000]], "id long")
    got = {r["id"]: r["component"] for r in H.connected_components(
        nodes, spark.createDataFrame(links, "i long, j long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1200)) and got[5000] == 5000


def test_tiles_do_not_show(cells):
    rng = np.random.default_rng(43)
    grid = rng.random((23, 31))
    grid[5, 6] = np.nan
    df = cells(grid.tolist())

    def run(tile):
        T.TILE, before = tile, T.TILE
        try:
            fns = (lambda z, p: {"o": T._gradient(z, p, 2.0, 1)}, lambda z, p: {"o": T._gradient(z, p, 2.0, 0)})
            return [{(r["r"], r["c"]): r["o"] for r in T.focal(df, f, ["o"], tile=tile).collect()} for f in fns]
        finally:
            T.TILE = before
    assert run(8) == run(256)
    gy, gx = np.gradient(grid, 2.0)
    got = run(8)
    for (r, c), v in got[0].items():
        assert v is None if math.isnan(gx[r, c]) or math.isnan(grid[r, c]) and v is None else v == pytest.approx(gx[r, c])
    for (r, c), v in got[1].items():
        assert v is None if math.isnan(gy[r, c]) or math.isnan(grid[r, c]) and v is None else v == pytest.approx(gy[r, c])


def test_map_match_continuity(spark):
    """Points closer to a parallel side road stay on the road the track is on."""
    segs = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0), (2, 0.0, 1.0, 100.0, 1.0)], "seg long, px double, py double, qx double, qy double")
    ys = [0.0, 0.45, 0.55, 0.45, 1.0, 0.55, 0.45]
    rows = [(9, i, f"2024-01-01 {20 + i:02d}:00:00" if i < 4 else f"2024-01-02 0{i}:00:00", i * 10.0, y) for i, y in enumerate(ys)]
    track = spark.createDataFrame(rows, "track long, id long, tm string, x double, y double").withColumn("tm", F.col("tm").cast("timestamp"))
    plain = {r["id"]: r["seg"] for r in J.map_match(track, segs, 2.0).collect()}
    assert [plain[i] for i in range(7)] == [1, 1, 2, 1, 2, 2, 1]
    sticky = {r["id"]: r["seg"] for r in J.map_match(track, segs, 2.0, switch_penalty=0.3).collect()}
    assert [sticky[i] for i in range(7)] == [1, 1, 1, 2, 2, 2, 2]
