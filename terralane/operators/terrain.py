"""Terrain operators on elevation cell tables.

Focal operators cut the raster into square tiles with a halo, so one shuffle of slightly
more than the raster serves any neighbourhood and a task never holds more than a tile.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from terralane.functions import geometry as G
from terralane.session import require

TILE = 256


# ---------------------------------------------------------------- tile engine

def focal(dem: DataFrame, fn: Callable, outputs: list[str], halo: int = 1, tile: int = TILE,
          also: str | None = None) -> DataFrame:
    """Run ``fn(z, present) -> {name: array}`` per tile and return r, c, v and the outputs.

    ``z`` is the tile with its halo (NaN for nodata and for missing cells), ``present`` tells
    which cells exist, so that ``fn`` can tell a raster edge from nodata. With ``also`` a
    second value column is passed as a third array. NaN becomes null.
    """
    require(dem, "r", "c", "v")
    second = [also] if also else []

    def tiles(axis):
        return F.sequence(F.floor((F.col(axis) - halo) / tile), F.floor((F.col(axis) + halo) / tile))
    spread = (dem.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"),
                         F.col("v").cast("double").alias("v"), *second)
              .withColumn("tr", F.explode(tiles("r"))).withColumn("tc", F.explode(tiles("c"))))
    side = tile + 2 * halo
    schema = "r long, c long, v double, " + ", ".join(f"{o} double" for o in outputs)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * tile - halo, key[1] * tile - halo
        ri, ci = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0
        z = np.full((side, side), np.nan)
        present = np.zeros((side, side), dtype=bool)
        z[ri, ci] = pdf["v"].to_numpy(dtype=float)
        present[ri, ci] = True
        given = [z, present]
        if also:
            other = np.full((side, side), np.nan)
            other[ri, ci] = pdf[also].to_numpy(dtype=float)
            given.append(other)
        with np.errstate(divide="ignore", invalid="ignore"):
            result = fn(*given)
        own = (ri >= halo) & (ri < halo + tile) & (ci >= halo) & (ci < halo + tile)
        data = {"r": pdf["r"][own].to_numpy(), "c": pdf["c"][own].to_numpy(),
                "v": z[ri[own], ci[own]]}
        for o in outputs:
            data[o] = np.asarray(result[o], dtype=float)[ri[own], ci[own]]
        return pd.DataFrame(data)

    out = spread.groupBy("tr", "tc").applyInPandas(run, schema)
    kinds = dict(dem.dtypes)
    return out.select(*[F.col(k).cast(kinds[k]).alias(k) for k in ("r", "c")], *[F.when(~F.isnan(x), F.col(x)).alias(x) for x in ["v", *outputs]])


def _shift(a: np.ndarray, dr: int, dc: int, fill) -> np.ndarray:
    """Value of the neighbour at (r + dr, c + dc)."""
    out = np.full_like(a, fill)
    n, m = a.shape
    out[max(0, -dr):n - max(0, dr), max(0, -dc):m - max(0, dc)] = \
        a[max(0, dr):n - max(0, -dr), max(0, dc):m - max(0, -dc)]
    return out


def _gradient(z: np.ndarray, present: np.ndarray, res: float, axis: int) -> np.ndarray:
    """Central differences, one-sided where the neighbour does not exist."""
    step = ((1, 0), (0, 1))[axis]
    ahead, behind = _shift(z, *step, np.nan), _shift(z, -step[0], -step[1], np.nan)
    has_a, has_b = _shift(present, *step, False), _shift(present, -step[0], -step[1], False)
    mid = (ahead - behind) / (2 * res)
    return np.where(has_a & has_b, mid, np.where(has_a, (ahead - z) / res,
                                                 np.where(has_b, (z - behind) / res, 0.0)))


def gradients(dem: DataFrame, res: float = 1.0, z: float = 1.0) -> DataFrame:
    """dz/dcolumn and dz/drow per cell; null next to nodata."""
    def fn(a, present):
        a = a * z
        gx, gy = _gradient(a, present, res, 1), _gradient(a, present, res, 0)
        gx[np.isnan(a)] = np.nan
        gy[np.isnan(a)] = np.nan
        return {"gx": gx, "gy": gy}
    return focal(dem, fn, ["gx", "gy"])


def slope(dem: DataFrame, res: float = 1.0, z: float = 1.0, unit: str = "degrees") -> DataFrame:
    """Slope in degrees or percent; ``z`` scales the elevation first."""
    g = gradients(dem, res, z)
    rise = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    if unit == "percent":
        return g.select("r", "c", (rise * 100).alias("slope"))
    if unit != "degrees":
        raise ValueError("unit must be degrees or percent")
    return g.select("r", "c", F.degrees(F.atan(rise)).alias("slope"))


def aspect(dem: DataFrame, res: float = 1.0) -> DataFrame:
    """atan2(dx, -dy) as a compass angle 0..360."""
    g = gradients(dem, res)
    a = F.degrees(F.atan2(F.col("gx"), -F.col("gy")))
    return g.select("r", "c", F.when(a < 0, a + 360.0).otherwise(a).alias("aspect"))


def _illumination(gx: Column, gy: Column, azimuth: float, altitude: float) -> Column:
    """Cosine of the angle between the sun and the surface normal; rows run south."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    sun_e, sun_n, sun_z = math.sin(az) * math.cos(alt), math.cos(az) * math.cos(alt), math.sin(alt)
    return (gx * -sun_e + gy * sun_n + sun_z) / F.sqrt(gx * gx + gy * gy + 1.0)


def hillshade(dem: DataFrame, res: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0,
              z: float = 1.0) -> DataFrame:
    """Standard cosine hillshade 0..255."""
    g = gradients(dem, res, z)
    lit = _illumination(F.col("gx"), F.col("gy"), azimuth, altitude)
    return g.select("r", "c", (F.greatest(F.lit(0.0), lit) * 255.0).alias("hillshade"))


# Coefficients of the published solar position series (degrees, centuries).
SUN_LONGITUDE = (280.46646, 36000.76983, 0.0003032)
SUN_ANOMALY = (357.52911, 35999.0503, -0.0001537)
OBLIQUITY = (23.439291, -0.013004, -0.00000016, 0.000000504)
SIDEREAL = (280.46061837, 360.98564736629, 0.000387933, -1 / 38710000.0)
UNIX_EPOCH_JD = 2440587.5
J2000 = 2451545.0
TRANSMISSION = 0.7


def sun_angles(seconds: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Sun azimuth (clockwise from north) and altitude in degrees for unix seconds (UTC)."""
    days = seconds / 86400.0 + (UNIX_EPOCH_JD - J2000)
    t = days / 36525.0

    def poly(coef):
        total = F.lit(0.0)
        for c in reversed(coef):
            total = total * t + c
        return total
    m = F.radians(F.pmod(poly(SUN_ANOMALY), F.lit(360.0)))
    centre = ((F.lit(1.9146) - t * 0.004817 - t * t * 0.000014) * F.sin(m)
              + (F.lit(0.019993) - t * 0.000101) * F.sin(m * 2) + F.sin(m * 3) * 0.00029)
    lam = F.radians(F.pmod(poly(SUN_LONGITUDE), F.lit(360.0)) + centre)
    eps = F.radians(poly(OBLIQUITY))
    declination = F.asin(F.sin(eps) * F.sin(lam))
    right_ascension = F.atan2(F.cos(eps) * F.sin(lam), F.cos(lam))
    sidereal = F.pmod(days * SIDEREAL[1] + SIDEREAL[0] + t * t * SIDEREAL[2] + t * t * t * SIDEREAL[3],
                      F.lit(360.0))
    hour_angle = F.radians(sidereal + lon) - right_ascension
    phi = F.radians(lat)
    altitude = F.asin(F.sin(phi) * F.sin(declination)
                      + F.cos(phi) * F.cos(declination) * F.cos(hour_angle))
    azimuth = F.atan2(-F.sin(hour_angle) * F.cos(declination),
                      F.cos(phi) * F.sin(declination)
                      - F.sin(phi) * F.cos(declination) * F.cos(hour_angle))
    return F.pmod(F.degrees(azimuth), F.lit(360.0)), F.degrees(altitude)


def sun_angles_at(spark, when: dt.datetime, lat: float, lon: float) -> tuple[float, float]:
    """The same angles for one moment, as two numbers."""
    stamp = when.replace(tzinfo=when.tzinfo or dt.timezone.utc).timestamp()
    az, alt = sun_angles(F.lit(stamp), F.lit(float(lat)), F.lit(float(lon)))
    return tuple(spark.range(1).select(az.alias("az"), alt.alias("alt")).first())


def terrain_shadow(dem: DataFrame, when: dt.datetime, lat: float, lon: float, res: float = 1.0) -> DataFrame:
    """Share of cells turned away from the sun at a moment."""
    azimuth, altitude = sun_angles_at(dem.sparkSession, when, lat, lon)
    if altitude <= 0:
        raise ValueError(f"the sun is below the horizon ({altitude:.2f} degrees)")
    g = gradients(dem, res)
    dark = F.when(_illumination(F.col("gx"), F.col("gy"), azimuth, altitude) < 0, 1).otherwise(0)
    return g.agg(F.sum(dark).alias("shaded_pixels"), F.count("*").alias("total_pixels"),
                 F.avg(dark).alias("shadow_ratio"),
                 F.lit(azimuth).alias("sun_azimuth"), F.lit(altitude).alias("sun_elevation"))


# ---------------------------------------------------------------- visibility and volumes

def viewshed(dem: DataFrame, row: int, col: int, height: float = 1.7, threshold: float = 0.0,
             res: float = 1.0, line_of_sight: bool = False) -> DataFrame:
    """Visible flag per cell from an observer cell.

    By default a cell is visible when its elevation angle exceeds ``threshold``. With
    ``line_of_sight`` the angle must reach that of every nearer cell that covers the ray to its centre.
    """
    seen = dem.filter((F.col("r") == row) & (F.col("c") == col)).select("v").first()
    if seen is None:
        raise ValueError("the observer is outside the raster")
    eye = float(seen[0] or 0.0) + height
    dr, dc = F.col("r") - F.lit(row), F.col("c") - F.lit(col)
    cells = F.sqrt((dr * dr + dc * dc).cast("double"))
    out = dem.withColumn("_d", F.greatest(cells, F.when(cells == 0, 1.0).otherwise(0.0)))
    out = out.withColumn("angle", F.atan2(F.col("v") - eye, F.col("_d") * res))
    own = (F.col("r") == row) & (F.col("c") == col)
    if not line_of_sight:
        shown = own | (F.col("angle") > threshold)
    else:
        # rays are half a cell apart at the raster edge; a near cell is wide and covers many of them
        far = out.agg(F.max("_d")).first()[0]
        rays = max(8, int(4 * math.pi * far))
        turn = (F.atan2(dc.cast("double"), dr.cast("double")) + math.pi) / (2 * math.pi) * rays
        wide = F.asin(F.least(F.lit(1.0), F.lit(0.5) / F.col("_d"))) / (2 * math.pi) * rays
        middle = F.floor(turn)
        out = out.withColumn("_mid", middle).withColumn(
            "_ray", F.explode(F.sequence(F.least(F.ceil(turn - wide), middle), F.greatest(F.floor(turn + wide), middle))))
        w = W.partitionBy(F.pmod("_ray", F.lit(rays))).orderBy((dr * dr + dc * dc).cast("long")).rangeBetween(W.unboundedPreceding, -1)
        nearer = F.max(F.when(~own, F.col("angle"))).over(w)
        out = out.withColumn("_nearer", nearer).filter(F.col("_ray") == F.col("_mid"))
        shown = own | F.col("_nearer").isNull() | (F.col("angle") >= F.col("_nearer"))
    return out.select("r", "c", F.when(F.col("v").isNotNull() & shown, 1).otherwise(0).alias("visible"))


def viewshed_summary(view: DataFrame) -> DataFrame:
    return view.agg(F.sum("visible").alias("visible_pixels"), F.count("*").alias("total_pixels"),
                    F.avg("visible").alias("visibility_ratio"))


def cut_fill(before: DataFrame, after: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """Fill and cut volumes between two surfaces; cut counts as negative."""
    diff = F.col("_a") - F.col("_b")
    both = (before.select("r", "c", F.col("v").alias("_b"))
            .join(after.select("r", "c", F.col("v").alias("_a")), ["r", "c"]).withColumn("d", diff))
    up, down = F.when(F.col("d") > 0, F.col("d")), F.when(F.col("d") < 0, F.col("d"))
    zero = F.lit(0.0)
    return both.agg((F.coalesce(F.sum(up), zero) * cell_area).alias("fill_volume"),
                    (F.coalesce(F.sum(down), zero) * cell_area).alias("cut_volume"),
                    (F.coalesce(F.sum("d"), zero) * cell_area).alias("net_volume"),
                    F.count(up).alias("fill_pixels"), F.count(down).alias("cut_pixels"))


def volume(dem: DataFrame, base: float = 0.0, cell_area: float = 1.0) -> DataFrame:
    """Volume and area above a level and the greatest height over it."""
    above = F.when(F.col("v") > base, F.col("v") - base)
    return dem.agg((F.coalesce(F.sum(above), F.lit(0.0)) * cell_area).alias("total_volume"),
                   (F.count(above) * cell_area).alias("surface_area"),
                   F.coalesce(F.max(above), F.lit(0.0)).alias("max_height"))


def elevation_profile(dem: DataFrame, grid: dict, line, n: int = 1000) -> DataFrame:
    """``n`` evenly spaced samples along a line of map coordinates: i, distance, x, y, elevation."""
    pts = [(float(x), float(y)) for x, y in line]
    if len(pts) < 2 or n < 2:
        raise ValueError("a profile needs two points and two samples")
    legs = [math.dist(a, b) for a, b in zip(pts, pts[1:])]
    total = sum(legs)
    at = F.col("id") * (total / (n - 1))
    x, y, start = F.lit(pts[-1][0]), F.lit(pts[-1][1]), total
    for (ax, ay), (bx, by), leg in reversed(list(zip(pts, pts[1:], legs))):
        start -= leg
        f = (at - start) / (leg or 1.0)
        inside = at < start + leg if (bx, by) != pts[-1] or start + leg < total else F.col("id") < n
        x = F.when(inside, F.lit(ax) + f * (bx - ax)).otherwise(x)
        y = F.when(inside, F.lit(ay) + f * (by - ay)).otherwise(y)
    samples = dem.sparkSession.range(n).select(
        F.col("id").alias("i"), at.alias("distance"), x.alias("x"), y.alias("y"))
    samples = samples.withColumns({
        "r": F.floor((F.col("y") - float(grid["y0"])) / float(grid["dy"])),
        "c": F.floor((F.col("x") - float(grid["x0"])) / float(grid["dx"]))})
    cells = dem.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"),
                       F.col("v").alias("elevation"))
    return (samples.join(cells, ["r", "c"], "left")
            .select("i", "distance", "x", "y", "elevation").orderBy("i"))


def profile_summary(profile: DataFrame) -> DataFrame:
    e = F.col("elevation")
    return profile.agg(F.min(e).alias("min_elevation"), F.max(e).alias("max_elevation"),
                       (F.max(e) - F.min(e)).alias("elevation_range"), F.avg(e).alias("mean_elevation"),
                       F.max("distance").alias("total_length"))


# ---------------------------------------------------------------- neighbourhoods

CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
SQUARE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _mirrored(z: np.ndarray, present: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """Neighbour value; beyond the raster the edge cell repeats."""
    out = np.where(_shift(present, dr, dc, False), _shift(z, dr, dc, np.nan), np.nan)
    gone = ~_shift(present, dr, dc, False)
    for er, ec in ((dr, 0), (0, dc), (0, 0)):
        here = gone & _shift(present, er, ec, False)
        out[here] = _shift(z, er, ec, np.nan)[here]
        gone &= ~here
    return out


def roughness(dem: DataFrame) -> DataFrame:
    """Population std of the 3 x 3 neighbourhood; edges repeat the edge cell."""
    def fn(z, present):
        stack = np.stack([_mirrored(z, present, i, j) for i, j in SQUARE])
        return {"roughness": stack.std(axis=0)}
    return focal(dem, fn, ["roughness"]).select("r", "c", "roughness")


def curvature(dem: DataFrame, res: float = 1.0, z: float = 1.0, dy: float | None = None) -> DataFrame:
    """Plan curvature from second differences; ``dy`` is the (signed) row spacing."""
    ry = -res if dy is None else dy

    def fn(a, present):
        gx, gy = _gradient(a, present, res, 1), _gradient(a, present, ry, 0)
        gyy = _gradient(gy, present, ry, 0)
        gxx, gxy = _gradient(gx, present, res, 1), _gradient(gx, present, ry, 0)
        k = (gx**2 * gyy - 2 * gx * gy * gxy + gy**2 * gxx) / (gx**2 + gy**2 + 1e-10) ** 1.5 * z
        return {"curvature": k}
    return focal(dem, fn, ["curvature"], halo=2).select("r", "c", "curvature")


def fill_depressions(dem: DataFrame) -> DataFrame:
    """Grey closing with a cross: largest of the cross, then smallest of that."""
    def fn(z, present):
        top = np.max(np.stack([_mirrored(z, present, i, j) for i, j in CROSS]), axis=0)
        return {"filled": np.min(np.stack([_mirrored(top, present, i, j) for i, j in CROSS]), axis=0)}
    return focal(dem, fn, ["filled"], halo=2).select("r", "c", "v", "filled")


# Flow codes in the order they are tried, as (row step, column step, code).
FLOW_CODES = [(1, 0, 1), (1, 1, 2), (0, 1, 4), (-1, 1, 8), (-1, 0, 16), (-1, -1, 32), (0, -1, 64),
              (1, -1, 128)]


def flow_direction(dem: DataFrame, res: float = 1.0) -> DataFrame:
    """Code of the steepest drop among eight neighbours; 0 on the border, flats and nodata."""
    def fn(z, present):
        best = np.zeros_like(z)
        code = np.zeros_like(z)
        inner = np.ones_like(present)
        for i, j, k in FLOW_CODES:
            inner &= _shift(present, i, j, False)
            far = math.sqrt(2) if i and j else 1.0
            drop = (z - _shift(z, i, j, np.nan)) / (far * res)
            better = drop > best            # false for NaN
            best[better] = drop[better]
            code[better] = k
        return {"dir": np.where(inner, code, 0.0)}
    return focal(dem, fn, ["dir"]).select("r", "c", F.col("dir").cast("int").alias("dir"))


def contour_segments(dem: DataFrame, interval: float, min_z: float | None = None,
                     grid: dict | None = None) -> DataFrame:
    """Marching squares: one row per segment with its level and end points.

    Coordinates are column / row positions of cell centres, or map units with ``grid``.
    """
    def fn(z, present):
        return {"e": _shift(z, 0, 1, np.nan), "s": _shift(z, 1, 0, np.nan), "se": _shift(z, 1, 1, np.nan)}
    q = focal(dem, fn, ["e", "s", "se"]).dropna()
    lo, hi = F.least("v", "e", "s", "se"), F.greatest("v", "e", "s", "se")
    first, last = F.floor(lo / interval) + 1, F.floor(hi / interval)
    if min_z is not None:
        first = F.greatest(first, F.lit(math.ceil(min_z / interval)))
    q = (q.filter(first <= last).withColumn("_n", F.explode(F.sequence(first, last)))
         .withColumn("level", F.col("_n") * float(interval)))
    lv = F.col("level")

    def crossing(a, b, ax, ay, bx, by):
        """Point on the edge a-b, or null when both ends are on one side."""
        t = (lv - a) / F.when(a == b, 1.0).otherwise(b - a)
        return F.when((a >= lv) != (b >= lv),
                      G.xy(F.col("c") + ax + t * (bx - ax), F.col("r") + ay + t * (by - ay)))
    v, e, s, se = (F.col(x) for x in ("v", "e", "s", "se"))
    top, right = crossing(v, e, 0, 0, 1, 0), crossing(e, se, 1, 0, 1, 1)
    bottom, left = crossing(s, se, 0, 1, 1, 1), crossing(v, s, 0, 0, 0, 1)
    q = q.withColumns({"_t": top, "_r": right, "_b": bottom, "_l": left})

    def pair(a, b):
        return F.struct(F.col(a).alias("p"), F.col(b).alias("q"))
    saddle = F.col("_t").isNotNull() & F.col("_b").isNotNull() & F.col("_l").isNotNull() & F.col("_r").isNotNull()
    joined_main = ((v + e + s + se) / 4 >= lv) == (v >= lv)
    ends = F.filter(F.array("_t", "_r", "_b", "_l"), lambda p: p.isNotNull())
    segs = (F.when(saddle & joined_main, F.array(pair("_t", "_r"), pair("_b", "_l")))
            .when(saddle, F.array(pair("_t", "_l"), pair("_r", "_b")))
            .otherwise(F.array(F.struct(ends[0].alias("p"), ends[1].alias("q")))))
    out = q.select("level", F.explode(segs).alias("g"))
    if grid is None:
        return out.select("level", F.col("g.p.x").alias("x1"), F.col("g.p.y").alias("y1"),
                          F.col("g.q.x").alias("x2"), F.col("g.q.y").alias("y2"))

    def mx(c):
        return F.lit(float(grid["x0"])) + (c + 0.5) * float(grid["dx"])

    def my(c):
        return F.lit(float(grid["y0"])) + (c + 0.5) * float(grid["dy"])
    return out.select("level", mx(F.col("g.p.x")).alias("x1"), my(F.col("g.p.y")).alias("y1"),
                      mx(F.col("g.q.x")).alias("x2"), my(F.col("g.q.y")).alias("y2"))


# ---------------------------------------------------------------- sun on buildings and sites

def simple_sun(ts: Column) -> tuple[Column, Column]:
    """The linear sun model: elevation and azimuth from hour and day of year."""
    hour = F.hour(ts) + F.minute(ts) / 60.0
    season = F.sin((F.dayofyear(ts) - 81.0) * (2 * math.pi / 365.0)) * 15.0
    elevation = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), F.lit(90.0) - F.abs(hour - 12.0) * 10.0) + season)
    return elevation, F.pmod((hour - 6.0) * 15.0 + 90.0, F.lit(360.0))


def cast_shadows(buildings: DataFrame, times: list, height: str = "height", model: str = "simple",
                 lat: float | None = None, lon: float | None = None) -> DataFrame:
    """Footprint moved by height / tan(elevation) along the azimuth, per building and time.

    Planar layers in metres. Heights of zero or less are skipped. ``model='solar'`` uses the
    sun position at lat / lon and skips times with the sun below the horizon.
    """
    require(buildings, "geom", height)
    # wall-clock times (UTC for the solar model), whatever the session time zone
    stamps = F.array(*[F.lit(str(t)).cast("timestamp_ntz") for t in times])
    out = (buildings.filter(F.col(height) > 0).withColumn("time", F.explode(stamps)))
    if model == "simple":
        elevation, azimuth = simple_sun(F.col("time"))
    else:
        seconds = (F.datediff(F.to_date("time"), F.lit("1970-01-01").cast("date")) * 86400.0
                   + F.hour("time") * 3600 + F.minute("time") * 60 + F.second("time"))
        azimuth, elevation = sun_angles(seconds, F.lit(float(lat)), F.lit(float(lon)))
    out = out.withColumns({"sun_elevation": elevation, "sun_azimuth": azimuth})
    if model != "simple":
        out = out.filter(F.col("sun_elevation") > 0)
    reach = F.col(height) / F.tan(F.radians(F.greatest(F.col("sun_elevation"), F.lit(1.0))))
    out = out.withColumns({"_dx": reach * F.sin(F.radians("sun_azimuth")),
                           "_dy": reach * F.cos(F.radians("sun_azimuth"))})
    moved = G.map_vertices(F.col("geom"), lambda x, y: (x + F.col("_dx"), y + F.col("_dy")))
    return G.with_bounds(out.withColumn("geom", moved)).drop("_dx", "_dy")


def solar_exposure(sites: DataFrame, days: list, step_hours: float = 1.0) -> DataFrame:
    """Per site and day (UTC): summed clear-sky intensity, daylight hours, highest sun.

    ``sites``: id, x (lon), y (lat). Intensity is 0.7^airmass * sin(altitude), with an
    airmass of 10 below five degrees.
    """
    steps = int(round(24 / step_hours))
    starts = [int(dt.datetime.fromisoformat(str(d)[:10]).replace(tzinfo=dt.timezone.utc).timestamp())
              for d in days]

    def hours(day, start):
        return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(
            F.lit(str(day)[:10]).alias("day"), (i * (step_hours * 3600.0) + float(start)).alias("s")))
    moments = F.flatten(F.array(*[hours(d, s) for s, d in zip(starts, days)]))
    grid = sites.select("id", "x", "y", F.explode(moments).alias("m"))
    _, altitude = sun_angles(F.col("m.s"), F.col("y"), F.col("x"))
    grid = grid.select("id", F.col("m.day").alias("day"), altitude.alias("alt"))
    zenith = F.lit(90.0) - F.col("alt")
    airmass = F.when(zenith < 85, F.lit(1.0) / F.cos(F.radians(F.least(zenith, F.lit(85.0))))).otherwise(10.0)
    light = F.when(F.col("alt") > 0, F.pow(F.lit(TRANSMISSION), airmass) * F.sin(F.radians("alt"))).otherwise(0.0)
    return grid.groupBy("id", "day").agg(
        (F.sum(light) * step_hours).alias("exposure"),
        (F.count(F.when(F.col("alt") > 0, 1)) * step_hours).alias("daylight_hours"),
        F.max("alt").alias("max_altitude"))
