"""Filters, coordinate conversions and per-feature measures of a layer.

The filters and conversions are stateless projections, so they also take a streaming
DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from terralane.functions import crs as C
from terralane.functions import geometry as G
from terralane.session import require, spread

# Unit factors from square metres and metres.
AREA_UNITS = {"sqm": 1.0, "sqkm": 1e6, "ha": 1e4}
LENGTH_UNITS = {"m": 1.0, "km": 1000.0, "mile": 1609.344}
DISTANCE_UNITS = {"meters": 1.0, "kilometers": 1000.0}


def select_by_attribute(df: DataFrame, field: str, op: str, value) -> DataFrame:
    """Attribute filter with = != > < >= <= like in."""
    require(df, field)
    c = F.col(field)
    tests = {"=": lambda: c == value, "!=": lambda: c != value, ">": lambda: c > value,
             "<": lambda: c < value, ">=": lambda: c >= value, "<=": lambda: c <= value,
             "like": lambda: c.like(value), "in": lambda: c.isin(list(value))}
    if op not in tests:
        raise ValueError(f"unknown operator {op!r}; use one of {list(tests)}")
    return df.filter(tests[op]())


def bbox_filter(df: DataFrame, bbox, exact: bool = False) -> DataFrame:
    """Rows whose box meets ``bbox``; with ``exact`` also the geometry must.

    The comparisons are plain column ranges, so parquet row groups are skipped.
    """
    x0, y0, x1, y1 = (float(v) for v in bbox)
    if "minx" in df.columns:
        out = df.filter((F.col("minx") <= x1) & (F.col("maxx") >= x0)
                        & (F.col("miny") <= y1) & (F.col("maxy") >= y0))
        if exact:
            out = out.filter(G.intersects(G.prepare(F.col("geom")), G.prepare(G.box_geometry(x0, y0, x1, y1))))
        return out
    return df.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def reproject_layer(df: DataFrame, src: int, dst: int) -> DataFrame:
    """Convert a point layer (x, y) or a feature layer (geom) between EPSG codes."""
    if "geom" not in df.columns:
        x, y = C.project(F.col("x"), F.col("y"), src, dst)
        return df.withColumns({"x": x, "y": y, "srid": F.lit(dst)})
    moved = G.map_vertices(F.col("geom"), lambda x, y: C.project(x, y, src, dst))
    return G.with_bounds(df.withColumn("geom", moved)).withColumn("srid", F.lit(dst))


def reproject_to_utm(df: DataFrame) -> DataFrame:
    """Lon/lat points to UTM, each in the zone of its longitude."""
    zone = C.utm_zone(F.col("x"), F.col("y"))
    x, y = C.to_utm(F.col("x"), F.col("y"), F.col("zone"))
    srid = F.when(F.col("y") < 0, 32700).otherwise(32600) + F.col("zone")
    return df.withColumn("zone", zone).withColumn("srid", srid).withColumns({"x": x, "y": y})


def convert_datum(df: DataFrame, src: str, dst: str) -> DataFrame:
    """WGS84, GCJ-02 and BD-09 point tables; points outside the China box do not move."""
    x, y = C.convert_datum(F.col("x"), F.col("y"), src, dst)
    return df.withColumns({"x": x, "y": y})


def infer_epsg(df: DataFrame) -> int:
    """4326 when all coordinates fit lon/lat, else 3857."""
    lo, hi = (("minx", "miny"), ("maxx", "maxy")) if "minx" in df.columns else (("x", "y"),) * 2
    x0, y0, x1, y1 = df.agg(F.min(lo[0]), F.min(lo[1]), F.max(hi[0]), F.max(hi[1])).first()
    fits = x0 is not None and -180 <= x0 and x1 <= 180 and -90 <= y0 and y1 <= 90
    return 4326 if fits else 3857


def define_crs(df: DataFrame, epsg: int | None = None) -> DataFrame:
    """Assign a coordinate system without moving coordinates; inferred when missing."""
    return df.withColumn("srid", F.lit(infer_epsg(df) if epsg is None else epsg))


def _in_mercator(geom: Column, srid: int) -> Column:
    if srid == 3857:
        return geom
    return G.map_vertices(geom, lambda x, y: C.project(x, y, srid, 3857))


def measure_area(df: DataFrame, unit: str = "sqm", col: str = "area", srid: int = 4326) -> DataFrame:
    """Area per feature in the Mercator plane, or in square degrees as stored."""
    require(df, "geom")
    if unit == "sqdeg":
        return df.withColumn(col, G.polygon_area(F.col("geom")))
    if unit not in AREA_UNITS:
        raise ValueError(f"unknown unit {unit!r}; use sqdeg or one of {list(AREA_UNITS)}")
    plane = df.withColumn("_plane", _in_mercator(F.col("geom"), srid))
    return plane.withColumn(col, G.polygon_area(F.col("_plane")) / AREA_UNITS[unit]).drop("_plane")


def measure_length(df: DataFrame, unit: str = "m", col: str = "length", srid: int = 4326,
                   plane: str = "3857") -> DataFrame:
    """Length per feature; ``plane='geodesic'`` sums haversine distances instead."""
    require(df, "geom")
    if unit == "deg":
        return df.withColumn(col, G.path_length(F.col("geom")))
    if unit not in LENGTH_UNITS:
        raise ValueError(f"unknown unit {unit!r}; use deg or one of {list(LENGTH_UNITS)}")
    if plane == "geodesic":
        length = G.path_length(F.col("geom"), "haversine")
    else:
        length = G.path_length(_in_mercator(F.col("geom"), srid))
    return df.withColumn(col, length / LENGTH_UNITS[unit])


def layer_total(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.sum(col).alias("total"), F.count("*").alias("feature_count"))


def centroids(df: DataFrame) -> DataFrame:
    """Attributes kept, geometry replaced by its centroid (also as x, y)."""
    require(df, "geom")
    out = df.withColumn("_c", G.centroid(F.col("geom")))
    out = out.withColumns({"x": F.col("_c.x"), "y": F.col("_c.y"),
                           "geom": G.point_geometry(F.col("_c.x"), F.col("_c.y"))}).drop("_c")
    if "minx" in df.columns:
        out = out.withColumns({"minx": F.col("x"), "maxx": F.col("x"),
                               "miny": F.col("y"), "maxy": F.col("y")})
    return out


def _douglas_peucker(points: np.ndarray, tol: float) -> np.ndarray:
    """Mask of kept vertices, with an explicit stack."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        inner = points[a + 1:b] - points[a]
        length2 = float(d @ d)
        if length2 == 0.0:
            dist = np.hypot(inner[:, 0], inner[:, 1])
        else:
            t = np.clip(inner @ d / length2, 0.0, 1.0)
            off = inner - t[:, None] * d
            dist = np.hypot(off[:, 0], off[:, 1])
        far = int(dist.argmax())
        if dist[far] > tol:
            keep[a + 1 + far] = True
            stack += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def simplify_layer(df: DataFrame, tol: float = 0.001) -> DataFrame:
    """Douglas-Peucker per path; adds vertex counts before and after.

    A ring that would fall below four vertices is left as it is.
    """
    require(df, "geom")
    if tol < 0:
        raise ValueError("the tolerance must not be negative")
    rings_type = df.select("geom.rings").schema[0].dataType

    @F.pandas_udf(rings_type)
    def simplify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rings_of in batches:
            out = []
            for rings in rings_of:
                kept = []
                for ring in rings:
                    pts = np.array([(p["x"], p["y"]) for p in ring], dtype=float)
                    if len(pts) > 2:
                        closed = bool((pts[0] == pts[-1]).all())
                        mask = _douglas_peucker(pts, tol)
                        if not (closed and mask.sum() < 4):
                            pts = pts[mask]
                    kept.append([{"x": x, "y": y} for x, y in pts.tolist()])
                out.append(kept)
            yield pd.Series(out)

    before = F.size(G.vertices(F.col("geom")))
    out = spread(df, F.xxhash64("geom")).withColumn("vertices_before", before).withColumn("_rings", simplify("geom.rings"))
    out = out.withColumn("geom", F.struct(F.col("geom.type").alias("type"),
                                          F.col("_rings").alias("rings"))).drop("_rings")
    return out.withColumn("vertices_after", F.size(G.vertices(F.col("geom"))))


def buffer_points(df: DataFrame, d: float, unit: str = "meters", plane: str = "geodesic",
                  segments: int = 64) -> DataFrame:
    """Round buffers of lon/lat points as ``segments``-gons.

    ``plane='3857'`` buffers in the Mercator plane; unit ``degrees`` buffers as stored.
    """
    require(df, "x", "y")
    if unit != "degrees" and unit not in DISTANCE_UNITS:
        raise ValueError("unit must be meters, kilometers or degrees")
    metres = d * DISTANCE_UNITS.get(unit, 1.0)
    ring = [(math.cos(2 * math.pi * i / segments), math.sin(2 * math.pi * i / segments))
            for i in range(segments)]
    spokes = F.array(*[G.xy(c, s) for c, s in ring + ring[:1]])
    if unit == "degrees":
        place = lambda p: G.xy(F.col("x") + p["x"] * d, F.col("y") + p["y"] * d)
    elif plane == "3857":
        mx, my = C.to_mercator(F.col("x"), F.col("y"))

        def place(p):
            lon, lat = C.from_mercator(mx + p["x"] * metres, my + p["y"] * metres)
            return G.xy(lon, lat)
    else:
        step = math.degrees(metres / G.EARTH_RADIUS)
        widen = F.cos(F.radians(F.col("y")))

        def place(p):
            return G.xy(F.col("x") + p["x"] * step / widen, F.col("y") + p["y"] * step)
    geom = G.geometry("Polygon", F.array(F.transform(spokes, place)))
    return G.with_bounds(df.withColumn("geom", geom))


def merge_layers(*layers: DataFrame) -> DataFrame:
    """Concatenate layers; columns are unioned and the source layer number is kept."""
    if not layers:
        raise ValueError("at least one layer is needed")
    out = layers[0].withColumn("layer", F.lit(0))
    for i, layer in enumerate(layers[1:], start=1):
        out = out.unionByName(layer.withColumn("layer", F.lit(i)), allowMissingColumns=True)
    return out
