"""Simplification that keeps shared borders shared: arcs between junctions, each simplified once.

A junction is a vertex with more or fewer than two different neighbours in the whole layer. The paths between junctions are the arcs; two
features that share a border hold the same arc, so simplifying every different arc by itself leaves no gap and no
overlap. Vertices go in the order of their effective areas (the triangle with both neighbours), as long as all that was
left out stays within the tolerance of the line that replaces it, and no vertex of the layer lies in the triangle. Then what an arc
sweeps over holds no vertex of another arc, so simplified arcs cannot cross, although they are worked on independently.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terralane.functions import geometry as G
from terralane.session import cut, require

#: Arcs that are simplified by one call, on average at most.
ARCS = 2048
_ARC = "fid long, path int, seq int, arc binary, backward boolean"


def _vertices(paths: DataFrame) -> DataFrame:
    """fid, path, i, x, y and the neighbours (null at the ends of open paths) of every vertex; the closing one is left out."""
    closed = (F.col("ring")[0] == F.element_at("ring", -1)) & (F.size("ring") > 3)
    loop = F.when(closed, F.slice("ring", F.lit(1), F.size("ring") - 1)).otherwise(F.col("ring"))
    n = F.size("loop")
    near = lambda at: F.when(F.col("closed"), F.get("loop", (F.col("i") + at + n) % n)).when(
        (F.col("i") + at).between(F.lit(0), n - 1), F.get("loop", F.col("i") + at))
    rows = paths.withColumns({"closed": closed, "loop": loop}).select("fid", "path", "closed", "loop", F.posexplode("loop").alias("i", "p"))
    return rows.select("fid", "path", "closed", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"), near(-1).alias("before"), near(1).alias("after"))


def _junctions(vertices: DataFrame) -> DataFrame:
    """The points with other than two different neighbours."""
    both = vertices.select("x", "y", F.explode(F.array("before", "after")).alias("n"))
    return both.groupBy("x", "y").agg(F.count_distinct(F.col("n.x"), F.col("n.y")).alias("n")).filter("n <> 2").select("x", "y")


def _canonical(points: np.ndarray) -> tuple[bytes, bool]:
    """An arc's points from its lesser end, and whether that is backward."""
    there, back = points.tolist(), points[::-1].tolist()
    return (points.tobytes(), False) if there <= back else (np.ascontiguousarray(points[::-1]).tobytes(), True)


def _arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arcs of each path, from rows fid, path, closed, points (struct x, y, junction in order)."""
    for batch in batches:
        rows = []
        points = batch.column("points")
        for fid, path, closed, own in zip(*(batch.column(c).to_pylist() for c in ("fid", "path", "closed")), points):
            flat = own.values
            at = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
            stops = np.flatnonzero(flat.field("junction").to_numpy(zero_copy_only=False))
            if closed:
                # a ring without junctions begins at its least point, in every feature that has it
                first = int(stops[0]) if len(stops) else int(np.lexsort((at[:, 1], at[:, 0]))[0])
                at = np.roll(at, -first, axis=0)
                at = np.concatenate([at, at[:1]])
                stops = (stops - first) % (len(at) - 1) if len(stops) else np.array([0])
                stops = np.unique(np.append(stops, len(at) - 1))
            else:
                stops = np.unique(np.concatenate([[0], stops, [len(at) - 1]]))
            for seq, (a, z) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist())):
                arc, backward = _canonical(np.ascontiguousarray(at[a:z + 1]))
                rows.append((fid, path, seq, arc, backward))
        if rows:
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["fid", "path", "seq", "arc", "backward"])


def _tiles_of(arcs: Iterator[pa.RecordBatch], tol: float, side: float) -> Iterator[pa.RecordBatch]:
    """The tiles within the tolerance of the edges of each arc that has an inner vertex."""
    for batch in arcs:
        rows = []
        for key, arc in zip(batch.column("key").to_pylist(), batch.column("arc").to_pylist()):
            at = np.frombuffer(arc, np.float64).reshape(-1, 2)
            if len(at) < 3:
                continue
            low = np.floor((np.minimum(at[:-1], at[1:]) - tol) / side).astype(np.int64)
            high = np.floor((np.maximum(at[:-1], at[1:]) + tol) / side).astype(np.int64)
            for tx, ty in {(x, y) for (a, b), (c, d) in zip(low.tolist(), high.tolist()) for x in range(a, c + 1) for y in range(b, d + 1)}:
                rows.append((key, tx, ty))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["key", "tx", "ty"])


def simplified(at: np.ndarray, others: np.ndarray, tol: float) -> np.ndarray:
    """Places of the vertices of an arc that stay. ``others``: points that must stay on their side; a loop keeps four points."""
    n = len(at)
    loop = bool((at[0] == at[-1]).all())
    before, after = np.arange(n) - 1, np.arange(n) + 1
    left, least = n, 4 if loop else 2
    guard = np.concatenate([others.reshape(-1, 2), at])

    def area(i: int) -> float:
        p, v, q = at[before[i]], at[i], at[after[i]]
        return abs((v[0] - p[0]) * (q[1] - p[1]) - (q[0] - p[0]) * (v[1] - p[1])) / 2

    def may_go(i: int) -> bool:
        a, b = before[i], after[i]
        p, q, v = at[a], at[b], at[i]
        d = q - p
        length = math.hypot(*d)
        inner = at[a + 1:b] - p
        if length == 0:
            return False
        t = np.clip(inner @ d / length ** 2, 0, 1)
        if (np.hypot(*(inner - t[:, None] * d).T) > tol).any():
            return False
        # vertices in the triangle, its rim included, but for its corners
        side = lambda s, e: (e[0] - s[0]) * (guard[:, 1] - s[1]) - (guard[:, 0] - s[0]) * (e[1] - s[1])
        one, two, three = side(p, v), side(v, q), side(q, p)
        hit = ((one >= 0) & (two >= 0) & (three >= 0)) | ((one <= 0) & (two <= 0) & (three <= 0))
        if one.size and hit.any():
            low, high = np.minimum(np.minimum(p, v), q), np.maximum(np.maximum(p, v), q)
            found = guard[hit & ((guard >= low) & (guard <= high)).all(axis=1)]
            corner = (found == p).all(axis=1) | (found == v).all(axis=1) | (found == q).all(axis=1)
            # what was left out between the corners has been swept over already
            if len(found[~corner]):
                gone = {tuple(x) for x in at[a + 1:b].tolist()}
                return all(tuple(x) in gone for x in found[~corner].tolist())
        return True

    heap = [(area(i), i) for i in range(1, n - 1)]
    heapq.heapify(heap)
    current = {i: a for a, i in heap}
    while heap and left > least:
        size, i = heapq.heappop(heap)
        if current.get(i) != size:
            continue
        if not may_go(i):
            current[i] = -1.0       # asked again when a neighbour goes
            continue
        del current[i]
        a, b = int(before[i]), int(after[i])
        after[a], before[b] = b, a
        left -= 1
        for k in (a, b):
            if k in current:
                current[k] = max(area(k), size)
                heapq.heappush(heap, (current[k], k))
    return np.array([0, *sorted(current), n - 1])


def simplify_topology(df: DataFrame, tol: float, key: str = "id") -> DataFrame:
    """``df`` with simplified shapes whose shared borders stay shared; adds vertices_before and vertices_after.

    No vertex moves, junctions and ends of lines stay, nothing left out lies further than ``tol`` from the line that replaces it. Borders are shared where
    features have the same vertices; a ring keeps at least three corners. Keys are unique and not null; null and empty geometries stay as they are.
    """
    require(df, key, "geom")
    if tol < 0:
        raise ValueError("the tolerance must not be negative")
    numbered = cut(df.withColumn("fid", F.monotonically_increasing_id()))
    paths = numbered.select("fid", F.posexplode("geom.rings").alias("path", "ring")).filter(F.size("ring") > 1)
    vertices = _vertices(paths)
    junctions = _junctions(vertices).withColumn("junction", F.lit(True))
    marked = vertices.select("fid", "path", "closed", "i", "x", "y").join(junctions, ["x", "y"], "left")
    whole = marked.groupBy("fid", "path", "closed").agg(F.sort_array(F.collect_list(F.struct(
        "i", "x", "y", F.coalesce("junction", F.lit(False)).alias("junction")))).alias("points"))
    refs = cut(whole.mapInArrow(_arcs, _ARC).withColumn("key", F.xxhash64("arc")))
    arcs = refs.groupBy("key", "arc").agg(F.count("*").alias("uses")).select("key", "arc")

    size = vertices.agg(F.avg(F.abs(F.col("x") - F.col("after.x")) + F.abs(F.col("y") - F.col("after.y"))).alias("s")).first()["s"] or 1.0
    side = max(4.0 * tol, 4.0 * size, 1e-9)
    tile = lambda c: F.floor(F.col(c) / side).cast("long")
    reached = arcs.mapInArrow(lambda batches: _tiles_of(batches, tol, side), "key long, tx long, ty long")
    # points of the layer that belong to no path are kept on their side as well
    points = numbered.select(F.explode(G.vertices(F.col("geom"))).alias("p")).select("p.x", "p.y").distinct().withColumns({"tx": tile("x"), "ty": tile("y")})
    others = reached.join(points, ["tx", "ty"]).select("key", "x", "y")

    def run(arc: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        rows = []
        near = near.sort_values("key", kind="stable")
        keys, guard = near["key"].to_numpy(np.int64), near[["x", "y"]].to_numpy(float)
        for key, content in zip(arc["key"], arc["arc"]):
            at = np.frombuffer(content, np.float64).reshape(-1, 2)
            first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            kept = simplified(at, guard[first:last], tol) if len(at) > 2 else np.arange(len(at))
            rows.append((key, content, np.ascontiguousarray(at[kept]).tobytes()))
        return pd.DataFrame(rows, columns=["key", "arc", "kept"])

    # many arcs a call: one call for each would cost far more than the work
    some = F.pmod(F.col("key"), F.lit(max(arcs.count() // ARCS, 1) + int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    done = arcs.groupBy(some).cogroup(others.groupBy(some)).applyInPandas(run, "key long, arc binary, kept binary")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fid, path, parts in zip(*(batch.column(c).to_pylist() for c in ("fid", "path", "parts"))):
                arcs_of = [np.frombuffer(p["kept"], np.float64).reshape(-1, 2)[::-1 if p["backward"] else 1] for p in parts]
                ring = np.concatenate([arcs_of[0], *(a[1:] for a in arcs_of[1:])])
                rows.append((fid, path, [{"x": x, "y": y} for x, y in ring.tolist()]))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["fid", "path", "ring"])

    parts = refs.join(done, ["key", "arc"]).groupBy("fid", "path").agg(F.sort_array(F.collect_list(F.struct("seq", "backward", "kept"))).alias("parts"))
    rings = parts.mapInArrow(joined, f"fid long, path int, ring {G.PATH_TYPE}")
    shapes = rings.groupBy("fid").agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "ring"))), lambda x: x["ring"]).alias("rings"))
    out = numbered.withColumn("vertices_before", F.size(G.vertices(F.col("geom")))).join(shapes, "fid", "left").drop("fid")
    geom = F.when(F.col("rings").isNull(), F.col("geom")).otherwise(F.struct(F.col("geom.type").alias("type"), F.col("rings").alias("rings")))
    out = out.withColumn("geom", geom).drop("rings")
    return out.withColumn("vertices_after", F.size(G.vertices(F.col("geom"))))
