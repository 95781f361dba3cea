"""Voronoi polygons of point seeds, cut out of a box.

A cell starts from the bisectors with its nearest seeds. It is right when no vertex of it is closer to another seed, so the vertices
themselves ask for their nearest seed, and every answer that is closer than the cell's own seed cuts the cell
again. Cells that have nothing left to ask are finished; dense clusters beside wide gaps need no more neighbours than
those that really bound a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terralane.functions import geometry as G
from terralane.operators.nearest import knn_join
from terralane.session import cut, require

#: Neighbours that a cell starts from.
FIRST = 12
#: A vertex counts as closer to another seed when it is by more than this share of the distance.
SLACK = 1e-9


def cut_cell(ring: np.ndarray, seed: np.ndarray, others: np.ndarray) -> np.ndarray:
    """An open convex ring without what is closer to one of the others than to the seed."""
    for other in others:
        normal = other - seed
        side = (ring - (seed + other) / 2) @ normal      # above 0: closer to the other
        if (side <= 0).all():
            continue
        following, ahead = np.roll(ring, -1, axis=0), np.roll(side, -1)
        cross = (side < 0) & (ahead > 0) | (side > 0) & (ahead < 0)
        t = np.where(cross, side / np.where(cross, side - ahead, 1.0), 0.0)[:, None]
        points = np.stack([ring, ring + t * (following - ring)], axis=1).reshape(-1, 2)
        ring = points[np.stack([side <= 0, cross], axis=1).ravel()]
    return ring


def _cells(box: tuple[float, float, float, float], ring_of):
    def run(key, own: pd.DataFrame) -> pd.DataFrame:
        seed = own[["x", "y"]].to_numpy(float)[0]
        others = own[["ox", "oy"]].dropna().to_numpy(float)
        others = others[np.lexsort((others[:, 1], others[:, 0], ((others - seed) ** 2).sum(axis=1)))]
        ring = cut_cell(ring_of(own, box), seed, others)
        far = np.sqrt(((ring - seed) ** 2).sum(axis=1)).max(initial=0.0)
        # the circle through the farthest vertex holds no seed beyond the known ones
        known = np.sqrt(((others - seed) ** 2).sum(axis=1)).max() if len(others) else 0.0
        return pd.DataFrame({"id": [key[0]], "x": [seed[0]], "y": [seed[1]], "ring": [ring.tobytes()], "done": [bool(own["complete"].iloc[0] and 2 * far <= known)]})
    return run


def _whole_box(own: pd.DataFrame, box) -> np.ndarray:
    x0, y0, x1, y1 = box
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)


def _present(own: pd.DataFrame, box) -> np.ndarray:
    return np.frombuffer(own["ring"].iloc[0], np.float64).reshape(-1, 2)


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, x, y of the seed, and vx, vy of every vertex of the unfinished cells."""
    for batch in batches:
        rows = []
        for key, x, y, ring in zip(*(batch.column(c).to_pylist() for c in ("id", "x", "y", "ring"))):
            rows += [(key, x, y, vx, vy) for vx, vy in np.frombuffer(ring, np.float64).reshape(-1, 2).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field("id").type), *(pa.array(c, pa.float64()) for c in list(zip(*rows))[1:])],
                                             ["id", "x", "y", "vx", "vy"])


def voronoi(seeds: DataFrame, key: str = "id", box: tuple[float, float, float, float] | None = None, pad: float = 0.01) -> DataFrame:
    """key, geom and area: the part of the box that is closer to each seed than to any other (planar).

    ``box``: x0, y0, x1, y1; by default the bounds of the seeds and ``pad`` on every side. Seeds without coordinates and seeds whose cell
    has no part in the box get no row; of seeds at one point the one with the least key has the cell.
    """
    require(seeds, key, "x", "y")
    kind = dict(seeds.dtypes)[key]
    given = seeds.select(F.col(key).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    points = cut(given.groupBy("x", "y").agg(F.min("id").alias("id")))
    n, *bounds = points.agg(F.count("*"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if box is None:
        box = (bounds[0] - pad, bounds[1] - pad, bounds[2] + pad, bounds[3] + pad) if n else (0.0, 0.0, 1.0, 1.0)
    elif box[0] >= box[2] or box[1] >= box[3]:
        raise ValueError("the box must have an area")
    schema = f"id {kind}, x double, y double, ring binary, done boolean"
    other = points.select(F.col("id").alias("b_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = knn_join(points, points, FIRST, exclude_self=True).join(other, "b_id").select(F.col("a_id").alias("id"), "ox", "oy")
    start = points.join(near, "id", "left").withColumn("complete", F.lit(True))
    cells = cut(start.groupBy("id").applyInPandas(_cells(box, _whole_box), schema))
    finished = [cells.filter("done")]
    cells = cells.filter("not done")
    while True:
        corners = cut(cells.mapInArrow(_corners, f"id {kind}, x double, y double, vx double, vy double").withColumn("vid", F.monotonically_increasing_id()))
        found = knn_join(corners, points, 1, a_id="vid", a_xy=("vx", "vy"))
        own = F.sqrt((F.col("vx") - F.col("x")) * (F.col("vx") - F.col("x")) + (F.col("vy") - F.col("y")) * (F.col("vy") - F.col("y")))
        closer = corners.join(found, corners.vid == found.a_id).filter((F.col("dist") < own * (1 - SLACK)) & (F.col("b_id") != F.col("id")))
        more = cut(closer.select("id", "b_id").distinct().join(other, "b_id").select("id", "ox", "oy"))
        if more.isEmpty():
            break
        changed = cells.join(more, "id").withColumn("complete", F.lit(False))
        finished.append(cells.join(more.select("id").distinct(), "id", "left_anti"))
        cells = cut(changed.groupBy("id").applyInPandas(_cells(box, _present), schema))
    whole = cells
    for part in finished:
        whole = whole.unionAll(part)

    def polygons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, content in enumerate(batch.column("ring").to_pylist()):
                ring = np.frombuffer(content, np.float64).reshape(-1, 2)
                if len(ring) >= 3:
                    rows.append((i, [[{"x": x, "y": y} for x, y in [*ring.tolist(), ring[0].tolist()]]]))
            if rows:
                rings = pa.array([r for _, r in rows], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([i for i, _ in rows])), rings], ["id", "rings"])

    rings = whole.select("id", "ring").mapInArrow(polygons, f"id {kind}, rings array<{G.PATH_TYPE}>")
    out = rings.select(F.col("id").alias(key), G.geometry("Polygon", F.col("rings")).alias("geom"))
    return out.withColumn("area", G.polygon_area(F.col("geom"))).filter(F.col("area") > 0)
