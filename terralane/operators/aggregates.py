"""Summaries of layers, tables, rasters, point clouds and graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from terralane.functions import crs as C
from terralane.operators.quantiles import exact_quantiles
from terralane.session import require

# Codes of the point classes that can be selected by name.
POINT_CLASSES = {"ground": 2, "building": 6, "vegetation_low": 1, "vegetation_medium": 4,
                 "vegetation_high": 5}
NATURAL_BINS = 1024


def type_label(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.StructType) and "rings" in dtype.names:
        return "geometry"
    return "unknown"


def summarize(df: DataFrame, by: str, stats: dict[str, str], order: str | None = None) -> DataFrame:
    """Group summary; ``stats`` maps a column to a function name. ``first`` is the value at the least ``order``."""
    require(df, by, *stats, *([order] if order else []))
    allowed = ("sum", "avg", "mean", "min", "max", "count", "stddev", "stddev_pop", "first",
               "count_distinct")
    bad = [f for f in stats.values() if f not in allowed]
    if bad:
        raise ValueError(f"unknown statistic {bad}; use one of {allowed}")
    if "first" in stats.values() and order is None:
        raise ValueError("first needs an order column")

    def agg(col, fn):
        if fn == "first":
            return F.min_by(col, order)
        return getattr(F, fn)(F.col(col))
    return df.groupBy(by).agg(*[agg(c, f).alias(f"{c}_{f}") for c, f in stats.items()])


def profile_layer(df: DataFrame, srid: int | None = None) -> DataFrame:
    """One row: feature count, box, geometry type counts, column labels."""
    if "minx" in df.columns:
        box = ("minx", "miny", "maxx", "maxy")
    else:
        box = ("x", "y", "x", "y")
    labels = {f.name: type_label(f.dataType) for f in df.schema.fields}
    kinds = (df.select(F.col("geom.type").alias("k")) if "geom" in df.columns
             else df.select(F.lit("Point").alias("k")))
    counts = kinds.groupBy("k").count()
    types = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count"))))
                       .alias("geometry_types"))
    sums = df.agg(F.count("*").alias("feature_count"), F.min(box[0]).alias("minx"),
                  F.min(box[1]).alias("miny"), F.max(box[2]).alias("maxx"),
                  F.max(box[3]).alias("maxy"))
    fits = (F.col("minx") >= -180) & (F.col("maxx") <= 180) & (F.col("miny") >= -90) & (F.col("maxy") <= 90)
    crs = F.lit(srid) if srid else F.when(fits, 4326).otherwise(3857)
    # both sides hold exactly one row
    return (sums.withColumn("_one", F.lit(1)).join(types.withColumn("_one", F.lit(1)), "_one").drop("_one")
            .withColumn("srid", crs)
            .withColumn("column_types", F.create_map(*[F.lit(s) for kv in labels.items() for s in kv]))
            .withColumn("numeric_columns", F.array(*[F.lit(c) for c, v in labels.items()
                                                     if v in ("integer", "float")]).cast("array<string>"))
            .withColumn("text_columns", F.array(*[F.lit(c) for c, v in labels.items()
                                                  if v == "text"]).cast("array<string>")))


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: label, row and null counts, mean, std, min, max when numeric.

    A single aggregate computes every statistic; the wide row is then unfolded.
    """
    aggs, entries = [F.count("*").alias("_rows")], []
    for i, f in enumerate(df.schema.fields):
        label = type_label(f.dataType)
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"n{i}"))
        if label in ("integer", "float"):
            aggs += [F.avg(c).alias(f"a{i}"), F.stddev_samp(c).alias(f"s{i}"),
                     F.min(c).cast("double").alias(f"l{i}"), F.max(c).cast("double").alias(f"h{i}")]
            nums = [F.col(f"{p}{i}") for p in "aslh"]
        else:
            nums = [F.lit(None).cast("double")] * 4
        entries.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(label).alias("type"),
            F.col("_rows").alias("row_count"), (F.col("_rows") - F.col(f"n{i}")).alias("null_count"),
            *[v.alias(n) for v, n in zip(nums, ("mean", "std", "min", "max"))]))
    return df.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def raster_stats(cells: DataFrame) -> DataFrame:
    """Per band: min, max, mean, population std, exact quartiles, valid and nodata counts."""
    cells = cells if "band" in cells.columns else cells.withColumn("band", F.lit(1))
    valid = F.when(F.col("v").isNotNull() & ~F.isnan("v"), F.col("v"))
    basic = cells.groupBy("band").agg(
        F.min(valid).alias("min"), F.max(valid).alias("max"), F.avg(valid).alias("mean"),
        F.stddev_pop(valid).alias("std"), F.count(valid).alias("valid_pixels"),
        (F.count("*") - F.count(valid)).alias("nodata_pixels"))
    q = exact_quantiles(cells, "v", [0.25, 0.5, 0.75], ["band"])
    return (basic.join(q, "band", "left")
            .withColumnsRenamed({"q0": "p25", "q1": "median", "q2": "p75"}))


def class_breaks(df: DataFrame, col: str, k: int, method: str = "equal") -> list[float]:
    """k + 1 break values: equal interval, quantile, or natural (least within-class squares)."""
    if method == "quantile":
        row = exact_quantiles(df, col, [i / k for i in range(k + 1)]).first()
        return [float(v) for v in row] if row else []
    lo, hi = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if lo is None:
        return []
    if method == "equal":
        return [lo + (hi - lo) * i / k for i in range(k)] + [hi]
    if method != "natural":
        raise ValueError("method must be equal, quantile or natural")
    width = (hi - lo) / NATURAL_BINS or 1.0
    v = F.col(col).cast("double")
    bins = (df.filter(v.isNotNull()).groupBy(F.least(F.floor((v - lo) / width), F.lit(NATURAL_BINS - 1)).alias("b"))
            .agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.max(v).alias("top"))
            .orderBy("b").collect())           # at most NATURAL_BINS rows
    tops = [r["top"] for r in bins]
    ends = _best_split(np.array([r["n"] for r in bins], float),
                       np.array([r["m"] for r in bins], float), min(k, len(bins)))
    return [lo] + [tops[e] for e in ends]


def _best_split(weight: np.ndarray, mean: np.ndarray, k: int) -> list[int]:
    """Last bin of each of k classes with the least within-class sum of squares."""
    n = len(weight)
    w = np.concatenate([[0.0], np.cumsum(weight)])
    s = np.concatenate([[0.0], np.cumsum(weight * mean)])
    q = np.concatenate([[0.0], np.cumsum(weight * mean * mean)])

    def spread(i, j):     # bins i..j-1, i may be an array
        ws = w[j] - w[i]
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / np.where(ws > 0, ws, 1.0)

    best = np.array([spread(0, j) for j in range(1, n + 1)])
    origin = []
    for _ in range(1, k):
        nxt, frm = np.full(n, np.inf), np.zeros(n, int)
        for j in range(2, n + 1):
            starts = np.arange(1, j)
            cost = best[starts - 1] + spread(starts, j)
            at = int(cost.argmin())
            nxt[j - 1], frm[j - 1] = cost[at], starts[at]
        origin.append(frm)
        best = nxt
    ends, j = [n - 1], n
    for frm in reversed(origin):
        j = int(frm[j - 1])
        ends.append(j - 1)
    return ends[::-1]


def classify(df: DataFrame, col: str, k: int = 5, method: str = "equal") -> DataFrame:
    """Add ``class`` 0..k-1; a value on a break belongs to the lower class."""
    breaks = class_breaks(df, col, k, method)
    above = F.lit(0)
    for b in breaks[1:-1]:
        above = above + F.when(F.col(col) > b, 1).otherwise(0)
    return df.withColumn("class", F.when(F.col(col).isNotNull(), above))


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("class").agg(F.count("*").alias("count"))


def density_grid(points: DataFrame, cell: float, weight: str | None = None) -> DataFrame:
    """Weighted number of points per grid cell (weight 1.0 when not given)."""
    w = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    return (points.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
            .agg(F.sum(w).alias("density"), F.count("*").alias("n")))


def height_stats(points: DataFrame) -> DataFrame:
    """Absolute and ground-relative heights; ground is the lowest class 2 point."""
    base = points.agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"),
                      F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_std"),
                      F.coalesce(F.min(F.when(F.col("cls") == 2, F.col("z"))),
                                 F.min("z")).alias("ground"))
    q = exact_quantiles(points, "z", [0.25, 0.5, 0.75])
    one = F.lit(1).alias("_one")
    out = base.select("*", one).join(q.select("*", one), "_one", "left").drop("_one")
    g = F.col("ground")
    return out.select("n", "z_min", "z_max", "z_mean", "ground", "z_std",
                      (F.col("z_min") - g).alias("rel_min"), (F.col("z_max") - g).alias("rel_max"),
                      (F.col("z_mean") - g).alias("rel_mean"), (F.col("q0") - g).alias("p25"),
                      (F.col("q1") - g).alias("p50"), (F.col("q2") - g).alias("p75"))


def filter_classes(points: DataFrame, classes) -> DataFrame:
    """Points of the named classes or class codes."""
    codes = [POINT_CLASSES[c] if isinstance(c, str) else int(c) for c in classes]
    if not codes:
        raise ValueError("choose at least one class")
    return points.filter(F.col("cls").isin(codes))


def ground_filter(points: DataFrame, q: float = 0.15, tile: float | None = None) -> DataFrame:
    """Points below the q-quantile of z, over the layer or per square tile."""
    if tile is None:
        limit = exact_quantiles(points, "z", [q]).select(F.col("q0").alias("_limit"))
        return (points.withColumn("_one", F.lit(1)).join(F.broadcast(limit.withColumn("_one", F.lit(1))), "_one")
                .filter(F.col("z") < F.col("_limit")).drop("_limit", "_one"))
    tiled = points.withColumns({"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)})
    limit = exact_quantiles(tiled, "z", [q], ["_tx", "_ty"])
    return tiled.join(limit, ["_tx", "_ty"]).filter(F.col("z") < F.col("q0")).drop("_tx", "_ty", "q0")


def extent(points: DataFrame) -> DataFrame:
    """Bounding box and the coordinate code: 4326, or the UTM code of the centre rule."""
    box = points.agg(F.min("x").alias("minx"), F.min("y").alias("miny"),
                     F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    geographic = (F.col("minx") >= -180) & (F.col("maxx") <= 180)
    zone = C.utm_zone(cx, cy)
    return box.withColumn("center_x", cx).withColumn("center_y", cy).withColumn(
        "utm_zone", F.when(geographic, zone)).withColumn(
        "epsg", F.when(geographic, F.lit(4326)))


def network_stats(edges: DataFrame) -> DataFrame:
    """Node and edge counts and the mean degree."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").count()
    return ends.agg(F.count("*").alias("nodes"),
                    (F.sum("count") / 2).cast("long").alias("edges"),
                    F.avg("count").alias("mean_degree"))


def profile_cells(cells: DataFrame, grid: dict) -> DataFrame:
    """Raster profile: bands, rows, columns, valid and nodata cells, resolution, extent."""
    cells = cells if "band" in cells.columns else cells.withColumn("band", F.lit(1))
    out = cells.agg(F.count_distinct("band").alias("bands"), F.min("r").alias("r0"),
                    F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"),
                    F.count("v").alias("valid"), (F.count("*") - F.count("v")).alias("nodata"))
    x0, y0, dx, dy = (float(grid[k]) for k in ("x0", "y0", "dx", "dy"))
    return out.select(
        "bands", (F.col("r1") - F.col("r0") + 1).cast("long").alias("rows"),
        (F.col("c1") - F.col("c0") + 1).cast("long").alias("cols"), "valid", "nodata",
        F.lit(dx).alias("res_x"), F.lit(abs(dy)).alias("res_y"), F.lit(int(grid.get("srid", 3857))).alias("srid"),
        (F.lit(x0) + F.col("c0") * dx).alias("minx"), (F.lit(x0) + (F.col("c1") + 1) * dx).alias("maxx"),
        F.least(F.lit(y0) + F.col("r0") * dy, F.lit(y0) + (F.col("r1") + 1) * dy).alias("miny"),
        F.greatest(F.lit(y0) + F.col("r0") * dy, F.lit(y0) + (F.col("r1") + 1) * dy).alias("maxy"),
        F.lit(dict(cells.dtypes)["v"]).alias("dtype"))
