"""Overlay, clipping, dissolving, hulls and buffers of polygon layers.

Two representations: exact rings where the clip shape is convex, and coverage cells (cells
of a stated size whose centre lies in the polygon) for everything else. The area error of
a coverage is at most the area of the cells the outline passes through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from terralane.functions import geometry as G
from terralane.operators.joins import BOX, bbox_pairs
from terralane.operators.nearest import knn_join
from terralane.session import require, spread

SLIVER = 1e-12     # exact pieces with less area are empty
OVERLAYS = {"intersection": "inner", "union": "full", "difference": "left_anti", "identity": "left",
            "symmetric_difference": "full"}
SPREAD = 64        # second-level groups of the hull


# ---------------------------------------------------------------- exact, convex clip shapes

def is_convex(geom: Column) -> Column:
    """One counter-clockwise ring that never turns right."""
    ring = geom["rings"][0]
    turns = G.edges_of_path(F.concat(ring, F.slice(ring, 2, 1)))
    corners = F.zip_with(F.slice(turns, 1, F.size(turns) - 1), F.slice(turns, 2, F.size(turns) - 1),
                         lambda e, f: G._cross(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"],
                                               f["q"]["x"], f["q"]["y"]))
    return (F.size(geom["rings"]) == 1) & F.forall(corners, lambda t: t >= 0)


def intersect_convex(a: DataFrame, b: DataFrame, a_id: str = "id", b_id: str = "id") -> DataFrame:
    """Exact pieces of ``a`` inside each convex polygon of ``b``: a_id, b_id, geom, area.

    Every ring of ``a`` is clipped, so holes and several parts stay right.
    """
    require(a, a_id, "geom", *BOX)
    require(b, b_id, "geom", *BOX)
    pairs = bbox_pairs(a.select(F.col(a_id).alias("id"), "geom", *BOX),
                       b.select(F.col(b_id).alias("id"), "geom", *BOX))
    hole = b.filter(~is_convex(F.col("geom"))).limit(1).count()
    if hole:
        raise ValueError("the clip layer has polygons that are not convex; use overlay() on cells")
    pairs = spread(pairs.withColumn("_box", G.is_own_box(F.col("b_geom"), *[F.col("b_" + c) for c in BOX])), "a_id", "b_id")
    # what lies in a box needs no clipping by it
    inside = (F.col("_box") & (F.col("a_minx") >= F.col("b_minx")) & (F.col("a_maxx") <= F.col("b_maxx"))
              & (F.col("a_miny") >= F.col("b_miny")) & (F.col("a_maxy") <= F.col("b_maxy")))
    clipped = F.filter(F.transform(F.col("a_geom.rings"),
                                   lambda r: G.clip_convex(r, F.col("b_geom.rings")[0])),
                       lambda r: F.size(r) > 0)
    rings = F.when(inside, F.col("a_geom.rings")).otherwise(clipped)
    out = pairs.select("a_id", "b_id", G.geometry("Polygon", rings).alias("geom"))
    out = out.withColumn("area", G.polygon_area(F.col("geom")))
    return out.filter(F.col("area") > SLIVER)


def clip(a: DataFrame, mask: DataFrame, key: str = "id") -> DataFrame:
    """Attributes of ``a`` with its geometry cut to the convex mask polygons.

    A feature inside several disjoint mask polygons gives one row per piece.
    """
    masks = mask.withColumn("_mid", F.monotonically_increasing_id())
    pieces = intersect_convex(a, masks, key, "_mid").select(F.col("a_id").alias(key), "geom", "area")
    keep = [c for c in a.columns if c not in ("geom", "area", *BOX)]
    return G.with_bounds(a.select(*keep).join(pieces, key))


# ---------------------------------------------------------------- coverage cells

def _cell_range(lo: Column, hi: Column, cell: float) -> Column:
    """Numbers of the cells whose centre lies between lo and hi."""
    first, last = F.ceil(lo / cell - 0.5), F.floor(hi / cell - 0.5)
    return F.when(first <= last, F.sequence(first, last))


def _grid_of(df: DataFrame, cell: float, grow: float = 0.0) -> DataFrame:
    """Candidate cells of the bounding box, rows first so that a huge box streams."""
    rows = df.withColumn("cy", F.explode(_cell_range(F.col("miny") - grow, F.col("maxy") + grow, cell)))
    return rows.withColumn("cx", F.explode(_cell_range(F.col("minx") - grow, F.col("maxx") + grow, cell)))


def _center(c: str, cell: float) -> Column:
    return (F.col(c) + 0.5) * cell


def coverage(df: DataFrame, cell: float) -> DataFrame:
    """One row per feature and covered cell: the columns of ``df`` without geometry, cx, cy."""
    keep = [c for c in df.columns if c not in ("geom", *BOX)]
    x, y = _center("cx", cell), _center("cy", cell)
    boxed = df.withColumn("_box", G.is_own_box(F.col("geom"), *[F.col(c) for c in BOX]))
    grid = _grid_of(boxed, cell).filter(F.col("_box") | G.covers_point(F.col("geom"), x, y))
    return grid.select(*keep, "cx", "cy")


def overlay(a: DataFrame, b: DataFrame, how: str, cell: float, a_id: str = "id",
            b_id: str = "id") -> DataFrame:
    """Cells of an overlay: cx, cy, a_id, b_id (null where a layer does not cover)."""
    if how not in OVERLAYS:
        raise ValueError(f"how must be one of {list(OVERLAYS)}")
    left = coverage(a.select(F.col(a_id).alias("a_id"), "geom", *BOX), cell)
    right = coverage(b.select(F.col(b_id).alias("b_id"), "geom", *BOX), cell)
    if how == "difference":
        out = left.join(right.select("cx", "cy"), ["cx", "cy"], "left_anti")
        return out.select("cx", "cy", "a_id", F.lit(None).cast(dict(right.dtypes)["b_id"]).alias("b_id"))
    out = left.join(right, ["cx", "cy"], OVERLAYS[how])
    if how == "symmetric_difference":
        out = out.filter(F.col("a_id").isNull() | F.col("b_id").isNull())
    return out.select("cx", "cy", "a_id", "b_id")


def overlay_area(cells: DataFrame, cell: float, *by: str) -> DataFrame:
    """Area per combination of ids (or other columns)."""
    keys = by or ("a_id", "b_id")
    return cells.groupBy(*keys).agg(F.count("*").alias("cells"), (F.count("*") * (cell * cell)).alias("area"))


def clip_coverage(a: DataFrame, mask: DataFrame, cell: float) -> DataFrame:
    """Coverage of ``a`` where any mask polygon covers, with the attributes of ``a`` only."""
    inside = coverage(mask.select("geom", *BOX), cell).select("cx", "cy")
    return coverage(a, cell).join(inside, ["cx", "cy"], "left_semi")


def dissolve(df: DataFrame, cell: float, by: str | None = None, key: str = "id") -> DataFrame:
    """Merged coverage per value of ``by`` (or of the whole layer).

    One row per group: covered cells and area, feature count, and the other attributes of
    the feature with the lowest ``key``.
    """
    group = by or "_all"
    base = df.withColumn("_all", F.lit(0))
    attrs = [c for c in df.columns if c not in ("geom", *BOX, key, by)]
    cells = coverage(base.select(group, "geom", *BOX), cell).distinct().groupBy(group).agg(
        F.count("*").alias("cells"), (F.count("*") * (cell * cell)).alias("area"))
    first = base.groupBy(group).agg(F.count("*").alias("features"),
                                    *[F.min_by(c, key).alias(c) for c in attrs])
    out = first.join(cells, group, "left").fillna({"cells": 0, "area": 0.0})
    return out if by else out.drop("_all")


def buffer_cells(df: DataFrame, d: float, cell: float, dissolve: bool = False) -> DataFrame:
    """Cells whose centre is within ``d`` of a line or polygon (planar units).

    With ``dissolve`` the distinct cells of the whole layer, else one row per feature.
    """
    keep = [c for c in df.columns if c not in ("geom", *BOX)]
    x, y = _center("cx", cell), _center("cy", cell)
    near = F.exists(F.col("_edges"), lambda e: G.point_segment_distance(
        x, y, e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]) <= d)
    inside = F.col("_polygon") & G.covers_point(F.col("geom"), x, y)
    given = df.withColumns({"_edges": G.edges(F.col("geom")), "_polygon": G.is_polygon(F.col("geom"))})     # once a feature, not for each cell
    cells = _grid_of(given, cell, d).filter(near | inside).select(*keep, "cx", "cy")
    return cells.select("cx", "cy").distinct() if dissolve else cells


def cells_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of ``a`` that are not in ``b``."""
    return a.join(b.select("cx", "cy"), ["cx", "cy"], "left_anti")


# ---------------------------------------------------------------- hulls and allocation

def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chain, counter-clockwise, first point not repeated."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out
    lower, upper = half(pts.tolist()), half(pts[::-1].tolist())
    return np.array(lower[:-1] + upper[:-1])


def convex_hull(df: DataFrame, by: str | None = None) -> DataFrame:
    """Hull polygon per group: points are reduced to partial hulls before every shuffle."""
    group = by or "_all"
    base = df.withColumn("_all", F.lit(0))
    if "geom" in df.columns:
        base = (base.select(group, F.explode(G.vertices(F.col("geom"))).alias("p"))
                .select(group, F.col("p.x").alias("x"), F.col("p.y").alias("y")))
    base = base.select(F.col(group).alias("g"), F.col("x").cast("double").alias("x"),
                       F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"])
    kind = dict(base.dtypes)["g"]
    schema = f"g {kind}, x double, y double"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, part in pdf.groupby("g", sort=False, dropna=False):
                h = _hull(part[["x", "y"]].to_numpy())
                yield pd.DataFrame({"g": [g] * len(h), "x": h[:, 0], "y": h[:, 1]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(h), "x": h[:, 0], "y": h[:, 1]})

    some = base.mapInPandas(partial, schema).withColumn("s", F.pmod(F.xxhash64("x", "y"), F.lit(SPREAD)))
    some = some.groupBy("g", "s").applyInPandas(merge, schema)

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["x", "y"]].to_numpy())
        path = [{"x": x, "y": y} for x, y in np.vstack([h, h[:1]]).tolist()]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "ring": [path]})

    rings = some.groupBy("g").applyInPandas(ring, f"g {kind}, ring {G.PATH_TYPE}")
    shape = F.when(F.size("ring") > 3, F.lit("Polygon")).when(F.size("ring") == 3, F.lit("LineString")).otherwise("Point")
    out = rings.select(F.col("g").alias(group), F.struct(shape.alias("type"), F.array("ring").alias("rings")).alias("geom"))
    out = G.with_bounds(out)
    return out if by else out.drop("_all")


def nearest_seed_allocation(seeds: DataFrame, rows: int, cols: int, pad: float = 0.01) -> DataFrame:
    """Discrete Voronoi: cells of the padded box that are nearest to each seed."""
    x0, y0, x1, y1 = seeds.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    x0, y0, x1, y1 = x0 - pad, y0 - pad, x1 + pad, y1 + pad
    dx, dy = (x1 - x0) / cols, (y1 - y0) / rows
    cells = seeds.sparkSession.range(rows * cols).select(
        "id", ((F.col("id") % cols + 0.5) * dx + x0).alias("x"),
        ((F.floor(F.col("id") / cols) + 0.5) * dy + y0).alias("y"))
    near = knn_join(cells, seeds, 1)
    return near.groupBy(F.col("b_id").alias("seed")).agg(
        F.count("*").alias("cells"), (F.count("*") * (dx * dy)).alias("area"))
