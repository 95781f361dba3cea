"""Raster operators on cell tables ``r, c, [band,] v`` where a null value is nodata."""

from __future__ import annotations

import ast
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from terralane.functions import crs as C
from terralane.functions import geometry as G
from terralane.operators.joins import bbox_pairs, points_in_polygons
from terralane.operators.nearest import knn_join
from terralane.operators.quantiles import exact_quantiles
from terralane.session import require


def cell_key(r: str = "r", c: str = "c") -> Column:
    """One long per cell; rows and columns must be below 2^31."""
    return F.shiftleft(F.col(r).cast("long"), 32) + F.col(c).cast("long")


def with_centers(cells: DataFrame, grid: dict) -> DataFrame:
    """Add the map coordinates x, y of the cell centres."""
    return cells.withColumns({
        "x": F.lit(float(grid["x0"])) + (F.col("c") + 0.5) * float(grid["dx"]),
        "y": F.lit(float(grid["y0"])) + (F.col("r") + 0.5) * float(grid["dy"])})


# ---------------------------------------------------------------- polygons and cells

def _cells_in(cells: DataFrame, polys: DataFrame, grid: dict, all_touched: bool) -> DataFrame:
    """Distinct (r, c) covered by any polygon."""
    centers = with_centers(cells.select("r", "c").distinct(), grid)
    if not all_touched:
        hits = points_in_polygons(centers, polys)
    else:
        hx, hy = abs(float(grid["dx"])) / 2, abs(float(grid["dy"])) / 2
        boxes = centers.withColumns({"minx": F.col("x") - hx, "maxx": F.col("x") + hx,
                                     "miny": F.col("y") - hy, "maxy": F.col("y") + hy})
        if "geom" in polys.columns:
            polys = polys.withColumns({
                "_box": G.is_own_box(F.col("geom"), *[F.col(b) for b in ("minx", "miny", "maxx", "maxy")]),
                "_prep": G.prepare(F.col("geom"))})
        hits = bbox_pairs(boxes, polys)
        if "geom" in polys.columns:
            box = G.box_geometry(F.col("a_minx"), F.col("a_miny"), F.col("a_maxx"), F.col("a_maxy"))
            hits = hits.filter(F.col("b__box") | G.intersects(G.prepare(box), F.col("b__prep")))
    return hits.select(F.col("a_r").alias("r"), F.col("a_c").alias("c")).distinct()


def clip_cells(cells: DataFrame, polys: DataFrame, grid: dict, all_touched: bool = False) -> DataFrame:
    """Cells whose centre (or any part) lies in a polygon."""
    return cells.join(_cells_in(cells, polys, grid, all_touched), ["r", "c"], "left_semi")


def mask_cells(cells: DataFrame, polys: DataFrame, grid: dict, invert: bool = False,
               nodata: float | None = None, all_touched: bool = False) -> DataFrame:
    """Keep values inside the polygons (outside with ``invert``), others become nodata."""
    inside = _cells_in(cells, polys, grid, all_touched).withColumn("_in", F.lit(True))
    keep = F.col("_in").isNull() if invert else F.col("_in").isNotNull()
    return (cells.join(inside, ["r", "c"], "left")
            .withColumn("v", F.when(keep, F.col("v")).otherwise(F.lit(nodata).cast("double")))
            .drop("_in"))


def zonal_stats(cells: DataFrame, zones: DataFrame, grid: dict, key: str = "id",
                stats=("mean", "sum", "count", "min", "max", "std")) -> DataFrame:
    """Statistics of the cells whose centre lies in each zone; empty zones give nulls."""
    known = {"mean": F.avg("a_v"), "sum": F.sum("a_v"), "count": F.count("a_v"),
             "min": F.min("a_v"), "max": F.max("a_v"), "std": F.stddev_pop("a_v")}
    bad = [s for s in stats if s not in known]
    if bad:
        raise ValueError(f"unknown statistic {bad}; use some of {list(known)}")
    valid = cells.filter(F.col("v").isNotNull())
    pairs = points_in_polygons(with_centers(valid, grid), zones)
    found = pairs.groupBy(F.col("b_" + key).alias("_z")).agg(*[known[s].alias(s) for s in stats])
    out = zones.select(key).join(found, F.col(key) == F.col("_z"), "left").drop("_z")
    return out.fillna(0, subset=["count"]) if "count" in stats else out


# ---------------------------------------------------------------- mosaics and sampling

def mosaic(*rasters: DataFrame, method: str = "first") -> DataFrame:
    """Merge rasters on a common grid; nodata never covers a value."""
    ranked = [r.select("r", "c", "v", F.lit(i).alias("_o")) for i, r in enumerate(rasters)]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    valid = F.when(F.col("v").isNotNull(), F.col("_o"))
    pick = {"first": F.min_by("v", valid), "last": F.max_by("v", valid),
            "min": F.min("v"), "max": F.max("v")}
    if method not in pick:
        raise ValueError(f"method must be one of {list(pick)}")
    return out.groupBy("r", "c").agg(pick[method].alias("v"))


def _kernel(method: str):
    """(reach, weight function of the distance) of a separable sampling kernel."""
    if method == "bilinear":
        return 1, lambda d: F.greatest(F.lit(0.0), F.lit(1.0) - d)
    if method == "cubic":     # Keys, a = -1/2
        return 2, lambda d: (F.when(d <= 1, (d * 1.5 - 2.5) * d * d + 1.0)
                             .when(d < 2, ((d * -0.5 + 2.5) * d - 4.0) * d + 2.0).otherwise(0.0))
    if method == "lanczos":
        def sinc(t):
            return F.when(t == 0, 1.0).otherwise(F.sin(t * math.pi) / F.when(t == 0, 1.0).otherwise(t * math.pi))
        return 3, lambda d: F.when(d < 3, sinc(d) * sinc(d / 3)).otherwise(0.0)
    raise ValueError("method must be nearest, bilinear, cubic or lanczos")


def sample(cells: DataFrame, targets: DataFrame, rows: int, cols: int, method: str = "nearest",
           keys=("r", "c")) -> DataFrame:
    """Values at fractional positions ``fr, fc`` (cell centres are whole numbers).

    ``targets`` hold ``keys``, fr and fc. Kernel samples beyond the raster edge use the edge
    cell; targets whose position lies outside the raster are nodata.
    """
    inside = F.col("fr").between(-0.5, rows - 0.5) & F.col("fc").between(-0.5, cols - 0.5)
    src = cells.select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), "v")

    def clamp(c, n):
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("long")

    if method == "nearest":
        want = targets.withColumns({
            "_sr": F.when(inside, clamp(F.floor(F.col("fr") + 0.5), rows)),
            "_sc": F.when(inside, clamp(F.floor(F.col("fc") + 0.5), cols))})
        return want.join(src, ["_sr", "_sc"], "left").select(*keys, "v")
    reach, weight = _kernel(method)
    steps = F.array(*[F.lit(i) for i in range(1 - reach, reach + 1)])
    want = (targets.filter(inside).withColumn("_i", F.explode(steps))
            .withColumn("_j", F.explode(steps)))
    nr, nc = F.floor("fr") + F.col("_i"), F.floor("fc") + F.col("_j")
    want = want.withColumns({"_sr": clamp(nr, rows), "_sc": clamp(nc, cols),
                             "_w": weight(F.abs(F.col("fr") - nr)) * weight(F.abs(F.col("fc") - nc))})
    want = want.filter(F.col("_w") != 0)
    hit = want.join(src, ["_sr", "_sc"]).filter(F.col("v").isNotNull())
    mixed = hit.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_w") * F.col("v")), F.sum("_w")).alias("v"))
    return targets.select(*keys).join(mixed, list(keys), "left")


def grid_cells(spark, rows: int, cols: int) -> DataFrame:
    """All (r, c) of a grid, generated in parallel."""
    return spark.range(rows * cols).select(
        F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))


def resample(cells: DataFrame, grid: dict, factor: float, method: str = "nearest") -> DataFrame:
    """Scale the grid by ``factor`` (2 doubles the resolution, 0.5 halves it)."""
    if factor <= 0:
        raise ValueError("the factor must be positive")
    rows, cols = int(grid["rows"]), int(grid["cols"])
    if method == "average":
        return (cells.groupBy(F.floor(F.col("r") * factor).alias("r"), F.floor(F.col("c") * factor).alias("c"))
                .agg(F.avg("v").alias("v")))
    out = grid_cells(cells.sparkSession, int(rows * factor), int(cols * factor))
    targets = out.withColumns({"fr": (F.col("r") + 0.5) / factor - 0.5,
                               "fc": (F.col("c") + 0.5) / factor - 0.5})
    return sample(cells, targets, rows, cols, method)


def warp(cells: DataFrame, grid: dict, dst_grid: dict, method: str = "nearest") -> DataFrame:
    """Reproject onto another grid: every target centre is mapped back and sampled."""
    out = with_centers(grid_cells(cells.sparkSession, int(dst_grid["rows"]), int(dst_grid["cols"])), dst_grid)
    x, y = C.project(F.col("x"), F.col("y"), int(dst_grid["srid"]), int(grid["srid"]))
    targets = out.select("r", "c", ((y - float(grid["y0"])) / float(grid["dy"]) - 0.5).alias("fr"),
                         ((x - float(grid["x0"])) / float(grid["dx"]) - 0.5).alias("fc"))
    return sample(cells, targets, int(grid["rows"]), int(grid["cols"]), method)


# ---------------------------------------------------------------- band arithmetic

def pivot_bands(cells: DataFrame, bands) -> DataFrame:
    """One row per cell with a column b<n> for each wanted band."""
    bands = sorted(set(bands))
    return (cells.filter(F.col("band").isin(bands)).groupBy("r", "c")
            .agg(*[F.max(F.when(F.col("band") == b, F.col("v"))).alias(f"b{b}") for b in bands]))


_FUNCTIONS = {"sqrt": F.sqrt, "log": F.ln, "exp": F.exp, "abs": F.abs, "sin": F.sin, "cos": F.cos,
              "minimum": F.least, "maximum": F.greatest}


def formula(text: str, names: dict[str, Column]) -> Column:
    """Arithmetic text to a column; only whitelisted names, numbers and functions.

    A division by zero gives null.
    """
    def build(node):
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in names:
            return names[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = build(node.left), build(node.right)
            ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b,
                   ast.Div: lambda: F.try_divide(a, b), ast.Pow: lambda: F.pow(a, b)}
            if type(node.op) in ops:
                return ops[type(node.op)]()
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS:
            return _FUNCTIONS[node.func.id](*[build(a) for a in node.args])
        raise ValueError(f"not allowed in a band formula: {ast.unparse(node)}; names: {sorted(names)}")
    return build(ast.parse(text, mode="eval"))


def _band_names(text: str, band_map: dict[str, int]) -> dict[str, int]:
    used = {n.id for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Name)}
    out = {}
    for name in used - set(_FUNCTIONS):
        if name in band_map:
            out[name] = int(band_map[name])
        elif name[:1] == "b" and name[1:].isdigit():
            out[name] = int(name[1:])
        else:
            raise ValueError(f"unknown band {name!r}; use b<number> or one of {sorted(band_map)}")
    return out


def _finite(c: Column, fill: float | None) -> Column:
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(ok, c).otherwise(F.lit(fill).cast("double"))


def band_math(cells: DataFrame, expr: str, band_map: dict[str, int] | None = None,
              fill: float | None = 0.0, null_as_zero: bool = True) -> DataFrame:
    """Evaluate a band formula per cell; results that are not finite become ``fill``."""
    names = _band_names(expr, band_map or {})
    wide = pivot_bands(cells, names.values())
    cols = {n: F.coalesce(F.col(f"b{b}"), F.lit(0.0)) if null_as_zero else F.col(f"b{b}")
            for n, b in names.items()}
    return wide.select("r", "c", _finite(formula(expr, cols), fill).alias("v"))


# Sensor band formulas, index formulas and their default bands.
SENSOR_FORMULAS = {
    "ndvi": {"sentinel2": "(b8-b4)/(b8+b4)", "landsat8": "(b5-b4)/(b5+b4)",
             "landsat9": "(b5-b4)/(b5+b4)", "auto": "(b2-b1)/(b2+b1)"},
    "ndwi": {"sentinel2": "(b3-b8)/(b3+b8)", "landsat8": "(b3-b5)/(b3+b5)",
             "landsat9": "(b3-b5)/(b3+b5)", "auto": "(b2-b8)/(b2+b8)"},
    "ndbi": {"sentinel2": "(b11-b8)/(b11+b8)", "landsat8": "(b6-b5)/(b6+b5)",
             "landsat9": "(b6-b5)/(b6+b5)", "auto": "(b11-b8)/(b11+b8)"},
}
INDEX_FORMULAS = {
    "NDVI": "(N-R)/(N+R)", "NDWI": "(G-N)/(G+N)", "EVI": "2.5*(N-R)/(N+6*R-7.5*B+1)",
    "EVI2": "2.5*(N-R)/(N+2.4*R+1)", "SAVI": "1.5*(N-R)/(N+R+0.5)",
    "MSAVI": "(2*N+1-sqrt(maximum((2*N+1)**2-8*(N-R),0)))/2",
    "NDBI": "(S1-N)/(S1+N)", "NDSI": "(G-S1)/(G+S1)", "MNDWI": "(G-S1)/(G+S1)",
    "LSWI": "(N-S1)/(N+S1)", "NDMI": "(N-S1)/(N+S1)", "NDRE": "(N-RE1)/(N+RE1)",
    "GNDVI": "(N-G)/(N+G)", "GCI": "N/G-1", "NBR": "(N-S2)/(N+S2)",
}
DEFAULT_BANDS = {"B": 2, "G": 3, "R": 4, "RE1": 5, "N": 8, "S1": 11, "S2": 12}
COMPOSITES = {"true_color": (3, 2, 1), "false_color": (4, 3, 2), "ndvi_color": (1, 4, 3)}
SAFE_FILL = -9999.0


def sensor_index(cells: DataFrame, index: str = "ndvi", sensor: str = "auto") -> DataFrame:
    """Index with the band formula of a sensor; inputs at or below -9999 are nodata."""
    if index not in SENSOR_FORMULAS:
        raise ValueError(f"index must be one of {list(SENSOR_FORMULAS)}")
    table = SENSOR_FORMULAS[index]
    clean = cells.withColumn("v", F.when(F.col("v") > SAFE_FILL, F.col("v")))
    return band_math(clean, table.get(sensor, table["auto"]), fill=None, null_as_zero=False)


def index_summary(cells: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and population std to four decimals."""
    return cells.agg(F.round(F.min("v"), 4).alias("min"), F.round(F.max("v"), 4).alias("max"),
                     F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("std"),
                     F.count("v").alias("valid_pixels"))


def spectral_index(cells: DataFrame, name: str, band_map: dict[str, int] | None = None,
                   fill: float | None = 0.0) -> DataFrame:
    """A named index; ``band_map`` overrides the default band numbers."""
    if name not in INDEX_FORMULAS:
        raise ValueError(f"unknown index {name!r}; use one of {sorted(INDEX_FORMULAS)}")
    return band_math(cells, INDEX_FORMULAS[name], {**DEFAULT_BANDS, **(band_map or {})}, fill)


def spectral_indices(cells: DataFrame, names, band_map: dict[str, int] | None = None,
                     fill: float | None = 0.0) -> DataFrame:
    """Several named indices as columns, from one pivot of the bands they need."""
    unknown = [n for n in names if n not in INDEX_FORMULAS]
    if unknown:
        raise ValueError(f"unknown index {unknown}; use some of {sorted(INDEX_FORMULAS)}")
    bands = {**DEFAULT_BANDS, **(band_map or {})}
    used = {k: b for n in names for k, b in _band_names(INDEX_FORMULAS[n], bands).items()}
    wide = pivot_bands(cells, used.values())
    cols = {k: F.coalesce(F.col(f"b{b}"), F.lit(0.0)) for k, b in used.items()}
    return wide.select("r", "c", *[_finite(formula(INDEX_FORMULAS[n], cols), fill).alias(n) for n in names])


def ndvi(cells: DataFrame, nir: int = 8, red: int = 4) -> DataFrame:
    """NDVI where a zero denominator or a missing band is nodata."""
    return band_math(cells, "(N-R)/(N+R)", {"N": nir, "R": red}, fill=None, null_as_zero=False)


def ndwi(cells: DataFrame, green: int = 3, nir: int = 8) -> DataFrame:
    return band_math(cells, "(G-N)/(G+N)", {"G": green, "N": nir}, fill=None, null_as_zero=False)


def ndvi_counts(index: DataFrame) -> DataFrame:
    return index.agg(F.count("v").alias("valid_pixels"), F.avg("v").alias("mean"),
                     F.min("v").alias("min"), F.max("v").alias("max"))


def ndwi_counts(index: DataFrame) -> DataFrame:
    return index.agg(F.count("v").alias("valid_pixels"),
                     F.count(F.when(F.col("v") > 0, 1)).alias("water_pixels"))


def all_indices(cells: DataFrame, band_count: int | None = None) -> DataFrame:
    """The indices the band count allows, in one pass over one pivot.

    Ten or more bands: NDVI, NDWI, MNDWI, NDBI, NBR. Six to nine bands take the near and
    short-wave infrared from bands 5, 6 and 7.
    """
    if band_count is None:
        band_count = cells.agg(F.max("band")).first()[0] or 0
    if band_count >= 10:
        bands = {"G": 3, "R": 4, "N": 8, "S1": 11, "S2": 12}
    elif band_count >= 6:
        bands = {"G": 3, "R": 4, "N": 5, "S1": 6, "S2": 7}
    else:
        raise ValueError(f"{band_count} bands are too few; at least 6 are needed")
    wanted = {"NDVI": ("N", "R"), "NDWI": ("G", "N"), "MNDWI": ("G", "S1"),
              "NDBI": ("S1", "N"), "NBR": ("N", "S2")}
    if band_count < 7:
        del wanted["NBR"]
        del bands["S2"]
    wide = pivot_bands(cells, bands.values())

    def pair(a, b):
        p, q = F.col(f"b{bands[a]}"), F.col(f"b{bands[b]}")
        return F.when(F.abs(p + q) > 1e-10, F.try_divide(p - q, p + q)).otherwise(SAFE_FILL)
    return wide.select("r", "c", *[pair(*ab).alias(n) for n, ab in wanted.items()])


def change_detection(before: DataFrame, after: DataFrame, method: str = "difference",
                     threshold: float = 0.1) -> DataFrame:
    """Change per cell with its class: increased, decreased or unchanged."""
    if method not in ("difference", "ratio"):
        raise ValueError("method must be difference or ratio")
    both = (before.select("r", "c", F.col("v").alias("_b"))
            .join(after.select("r", "c", F.col("v").alias("_a")), ["r", "c"]))
    change = F.col("_a") - F.col("_b")
    if method == "ratio":
        change = F.try_divide(change, F.col("_b") + 1e-10)
    change = _finite(change, 0.0)
    kind = (F.when(change > threshold, "increased").when(change < -threshold, "decreased")
            .otherwise("unchanged"))
    return both.select("r", "c", change.alias("change"), kind.alias("kind"))


def change_summary(changes: DataFrame) -> DataFrame:
    n = F.count("*")
    moved = F.count(F.when(F.col("kind") != "unchanged", 1))
    return changes.agg(
        F.min("change").alias("change_min"), F.max("change").alias("change_max"),
        F.avg("change").alias("change_mean"),
        F.count(F.when(F.col("kind") == "increased", 1)).alias("increased_pixels"),
        F.count(F.when(F.col("kind") == "decreased", 1)).alias("decreased_pixels"),
        F.count(F.when(F.col("kind") == "unchanged", 1)).alias("unchanged_pixels"),
        n.alias("total_pixels"), (moved / n).alias("change_ratio"))


def classify_cells(cells: DataFrame, method: str = "kmeans", k: int = 5, seed: int = 42) -> DataFrame:
    """Unsupervised classes: k-means over all bands or equal intervals of the first band."""
    bands = sorted(r[0] for r in cells.select("band").distinct().collect())  # few sensor bands
    if method == "threshold":
        first = cells.filter(F.col("band") == bands[0])
        lo, hi = first.agg(F.min(F.coalesce("v", F.lit(0.0))), F.max(F.coalesce("v", F.lit(0.0)))).first()
        step = (hi - lo) / k
        v = F.coalesce("v", F.lit(0.0))
        label = F.least(F.floor((v - lo) / step), F.lit(k - 1)) if step else F.lit(0)
        return first.select("r", "c", label.cast("long").alias("class"))
    if method != "kmeans":
        raise ValueError("method must be kmeans or threshold")
    wide = pivot_bands(cells, bands).fillna(0.0)
    data = VectorAssembler(inputCols=[f"b{b}" for b in bands], outputCol="features").transform(wide)
    model = KMeans(k=k, seed=seed, maxIter=50).fit(data)
    return model.transform(data).select("r", "c", F.col("prediction").cast("long").alias("class"))


def composite(cells: DataFrame, kind: str = "false_color") -> DataFrame:
    """Three bands stretched between their 2nd and 98th percentile to 0..255."""
    if kind not in COMPOSITES:
        raise ValueError(f"kind must be one of {list(COMPOSITES)}")
    bands = COMPOSITES[kind]
    wide = pivot_bands(cells, bands)
    limits = exact_quantiles(cells.filter(F.col("band").isin(list(bands))), "v", [0.02, 0.98], ["band"])
    cut_at = {r["band"]: (r["q0"], r["q1"]) for r in limits.collect()}    # three rows

    def stretch(b):
        lo, hi = cut_at[b]
        s = (F.col(f"b{b}") - lo) / (hi - lo + 1e-10) * 255.0
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), s))).cast("long")
    return wide.select("r", "c", *[stretch(b).alias(n) for b, n in zip(bands, ("red", "green", "blue"))])


def cloud_mask(cells: DataFrame, band: int = 1, threshold: float = 0.15) -> DataFrame:
    """Cells brighter than ``threshold`` times the band mean are cloud."""
    one = cells.filter(F.col("band") == band)
    mean = one.agg(F.avg("v").alias("_m")).withColumn("_one", F.lit(1))       # one row
    bright = F.col("v") / (F.col("_m") + 1e-10)
    return (one.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one")
            .select("r", "c", F.when(bright > threshold, 1).otherwise(0).alias("cloud")))


def cloud_summary(mask: DataFrame) -> DataFrame:
    return mask.agg(F.sum("cloud").alias("cloud_pixels"), F.count("*").alias("total_pixels"),
                    F.avg("cloud").alias("cloud_ratio"))


RULE_CHAIN = 64     # longer rule tables are looked up instead of chained


def reclassify(cells: DataFrame, ranges, closed: str = "right", nodata: float | None = -9999.0) -> DataFrame:
    """Map value ranges ``(lo, hi, value)``; later rules win, unmatched cells are nodata."""
    if closed not in ("right", "left"):
        raise ValueError("closed must be right or left")
    rules = [(float(lo), float(hi), float(val)) for lo, hi, val in ranges]
    v = F.col("v")

    def match(lo, hi):
        return (v > lo) & (v <= hi) if closed == "right" else (v >= lo) & (v < hi)
    if len(rules) <= RULE_CHAIN:
        out = F.lit(nodata).cast("double")
        for lo, hi, val in rules:
            out = F.when(match(lo, hi), F.lit(val)).otherwise(out)
        return cells.withColumn("v", out)
    # long tables: the rules are cut into runs without overlap, each with its last rule, and a value looks its run up
    edges, winner = _rule_runs(rules)
    side = "left" if closed == "right" else "right"
    values = np.array([val for *_, val in rules])

    @F.arrow_udf("double")
    def look_up(x: pa.Array) -> pa.Array:
        run = np.searchsorted(edges, x.to_numpy(zero_copy_only=False).astype(float), side)     # run i lies between edges i - 1 and i
        rule = winner[run]
        return pa.array(values[np.maximum(rule, 0)], mask=rule < 0)
    found = F.when(v.isNotNull(), look_up(v.cast("double")))
    return cells.withColumn("v", F.coalesce(found, F.lit(nodata).cast("double")))


def _rule_runs(rules: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the rules in order, and for the run before each end and behind the last one the last rule that holds there (-1: none)."""
    edges = np.unique(np.array([end for lo, hi, _ in rules for end in (lo, hi)]))
    winner = np.full(len(edges) + 1, -1)
    first, last = (np.searchsorted(edges, np.array([rule[k] for rule in rules])) for k in (0, 1))
    free = list(range(len(edges) + 1))      # the next run at or behind each that no later rule has taken
    for rule in reversed(range(len(rules))):
        at = first[rule] + 1
        while at <= last[rule]:
            after = at
            while free[after] != after:
                free[after] = free[free[after]]
                after = free[after]
            if after <= last[rule]:
                winner[after], free[after] = rule, after + 1
            at = after + 1
    return edges, winner


def fill_nodata(cells: DataFrame, max_dist: float = 10.0) -> DataFrame:
    """Fill nodata from the nearest valid cell within ``max_dist`` cells.

    Ties go to the first cell in row order.
    """
    require(cells, "r", "c", "v")
    keyed = cells.withColumn("_k", cell_key())
    pts = keyed.select("_k", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), "v")
    near = knn_join(pts.filter(F.col("v").isNull()), pts.filter(F.col("v").isNotNull()), 1,
                    max_dist, a_id="_k", b_id="_k")
    values = pts.select(F.col("_k").alias("b_id"), F.col("v").alias("_fill"))
    fills = near.join(values, "b_id").select(F.col("a_id").alias("_k"), "_fill")
    return (keyed.join(fills, "_k", "left").withColumn("v", F.coalesce("v", "_fill"))
            .drop("_k", "_fill"))


def weighted_overlay(layers: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Min-max normalise each layer and add them up; weights are rescaled to one.

    All layers share one grid: the union is aggregated once instead of joined pairwise.
    """
    if set(layers) != set(weights):
        raise ValueError("layers and weights must have the same names")
    total = sum(weights.values())
    rows, limits = None, None
    for name, df in layers.items():
        part = df.select("r", "c", "v", F.lit(name).alias("layer"))
        rows = part if rows is None else rows.unionByName(part)
    limits = rows.groupBy("layer").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = F.create_map(*[F.lit(x) for n, w in weights.items() for x in (n, w / total)])
    span = F.col("hi") - F.col("lo")
    norm = F.when(span > 0, (F.col("v") - F.col("lo")) / F.when(span > 0, span).otherwise(1.0)).otherwise(0.0)
    # limits hold one row per layer
    scored = rows.join(F.broadcast(limits), "layer").withColumn("_s", share[F.col("layer")] * norm)
    complete = F.count("v") == len(layers)
    return scored.groupBy("r", "c").agg(F.when(complete, F.sum("_s")).alias("v"))
