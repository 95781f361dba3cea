"""Closed-form coordinate conversions as column expressions.

Supported: lon/lat (4326), spherical Mercator (3857), UTM zones (326zz / 327zz) and
the two Chinese datum offsets (GCJ-02, BD-09).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Ellipsoids and offsets of the published datum formulas.
MERCATOR_RADIUS = 6378137.0
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
UTM_K0 = 0.9996
GCJ_A = 6378245.0
GCJ_EE = 0.00669342162296594323
CHINA_BOX = (72.004, 0.8293, 137.8347, 55.8271)
BD_SHIFT = (0.0065, 0.006)


def to_mercator(lon: Column, lat: Column):
    return (F.radians(lon) * MERCATOR_RADIUS,
            F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS)


def from_mercator(x: Column, y: Column):
    return (F.degrees(x / MERCATOR_RADIUS),
            F.degrees(F.atan(F.exp(y / MERCATOR_RADIUS)) * 2 - math.pi / 2))


def utm_zone(lon: Column, lat: Column) -> Column:
    """Zone number with the Norway and Svalbard exceptions."""
    plain = F.least(F.floor((lon + 180.0) / 6.0) + 1, F.lit(60))
    svalbard = ((lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42))
    return (F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), F.lit(32))
            .when(svalbard & (lon < 9), F.lit(31)).when(svalbard & (lon < 21), F.lit(33))
            .when(svalbard & (lon < 33), F.lit(35)).when(svalbard, F.lit(37))
            .otherwise(plain).cast("int"))


def _utm_constants():
    n = WGS84_F / (2 - WGS84_F)
    rect = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
             13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return n, rect, alpha, beta, delta


def to_utm(lon: Column, lat: Column, zone, south=None):
    """Krüger series to third order (millimetres within a zone)."""
    n, rect, alpha, _, _ = _utm_constants()
    zone = zone if isinstance(zone, Column) else F.lit(zone)
    south = (lat < 0) if south is None else F.lit(south)
    lam = F.radians(lon - (zone * 6.0 - 183.0))
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.atanh(s * e) * e)
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(t * t + 1.0))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
    return (east * (UTM_K0 * rect) + 500000.0,
            north * (UTM_K0 * rect) + F.when(south, F.lit(1e7)).otherwise(F.lit(0.0)))


def from_utm(x: Column, y: Column, zone, south=False):
    _, rect, _, beta, delta = _utm_constants()
    zone = zone if isinstance(zone, Column) else F.lit(zone)
    xi = (y - F.when(F.lit(south), F.lit(1e7)).otherwise(F.lit(0.0))) / (UTM_K0 * rect)
    eta = (x - 500000.0) / (UTM_K0 * rect)
    xi0, eta0 = xi, eta
    for j, b in enumerate(beta, start=1):
        xi0 = xi0 - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        eta0 = eta0 - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi
    for j, d in enumerate(delta, start=1):
        lat = lat + F.sin(chi * (2 * j)) * d
    lon = F.atan2(F.sinh(eta0), F.cos(xi0))
    return F.degrees(lon) + (zone * 6.0 - 183.0), F.degrees(lat)


def _utm_code(epsg: int):
    if 32601 <= epsg <= 32660:
        return epsg - 32600, False
    if 32701 <= epsg <= 32760:
        return epsg - 32700, True
    return None


def project(x: Column, y: Column, src: int, dst: int):
    """Convert one coordinate pair between the supported EPSG codes."""
    if src == dst:
        return x, y
    if src == 4326:
        lon, lat = x, y
    elif src == 3857:
        lon, lat = from_mercator(x, y)
    elif _utm_code(src):
        zone, south = _utm_code(src)
        lon, lat = from_utm(x, y, zone, south)
    else:
        raise ValueError(f"EPSG:{src} is not supported; use 4326, 3857 or a UTM zone code")
    if dst == 4326:
        return lon, lat
    if dst == 3857:
        return to_mercator(lon, lat)
    if _utm_code(dst):
        zone, south = _utm_code(dst)
        return to_utm(lon, lat, zone, south)
    raise ValueError(f"EPSG:{dst} is not supported; use 4326, 3857 or a UTM zone code")


def outside_china(lon: Column, lat: Column) -> Column:
    x0, y0, x1, y1 = CHINA_BOX
    return ~(lon.between(x0, x1) & lat.between(y0, y1))


def _gcj_offset(lon: Column, lat: Column):
    x, y = lon - 105.0, lat - 35.0
    pi = math.pi

    def wave(*terms):
        total = F.lit(0.0)
        for weight, angle in terms:
            total = total + F.sin(angle) * weight
        return total * 2.0 / 3.0

    ripple = wave((20.0, x * 6.0 * pi), (20.0, x * 2.0 * pi))
    dlat = (F.lit(-100.0) + x * 2.0 + y * 3.0 + y * y * 0.2 + x * y * 0.1
            + F.sqrt(F.abs(x)) * 0.2 + ripple
            + wave((20.0, y * pi), (40.0, y / 3.0 * pi))
            + wave((160.0, y / 12.0 * pi), (320.0, y * pi / 30.0)))
    dlon = (F.lit(300.0) + x + y * 2.0 + x * x * 0.1 + x * y * 0.1
            + F.sqrt(F.abs(x)) * 0.1 + ripple
            + wave((20.0, x * pi), (40.0, x / 3.0 * pi))
            + wave((150.0, x / 12.0 * pi), (300.0, x / 30.0 * pi)))
    rad = F.radians(lat)
    magic = F.lit(1.0) - F.sin(rad) * F.sin(rad) * GCJ_EE
    root = F.sqrt(magic)
    dlat = dlat * 180.0 / (F.lit(GCJ_A * (1 - GCJ_EE)) / (magic * root) * pi)
    dlon = dlon * 180.0 / (F.lit(GCJ_A) / root * F.cos(rad) * pi)
    return dlon, dlat


def wgs_to_gcj(lon: Column, lat: Column):
    dlon, dlat = _gcj_offset(lon, lat)
    out = outside_china(lon, lat)
    return F.when(out, lon).otherwise(lon + dlon), F.when(out, lat).otherwise(lat + dlat)


def gcj_to_wgs(lon: Column, lat: Column):
    """Inverse by fixed point: the offset is taken at the estimate, not at the shifted point."""
    x, y = lon, lat
    for _ in range(2):
        dlon, dlat = _gcj_offset(x, y)
        x, y = lon - dlon, lat - dlat
    out = outside_china(lon, lat)
    return F.when(out, lon).otherwise(x), F.when(out, lat).otherwise(y)


def gcj_to_bd(lon: Column, lat: Column):
    k = math.pi * 3000.0 / 180.0
    z = F.sqrt(lon * lon + lat * lat) + F.sin(lat * k) * 0.00002
    theta = F.atan2(lat, lon) + F.cos(lon * k) * 0.000003
    return z * F.cos(theta) + BD_SHIFT[0], z * F.sin(theta) + BD_SHIFT[1]


def bd_to_gcj(lon: Column, lat: Column):
    k = math.pi * 3000.0 / 180.0
    x, y = lon - BD_SHIFT[0], lat - BD_SHIFT[1]
    z = F.sqrt(x * x + y * y) - F.sin(y * k) * 0.00002
    theta = F.atan2(y, x) - F.cos(x * k) * 0.000003
    return z * F.cos(theta), z * F.sin(theta)


def convert_datum(lon: Column, lat: Column, src: str, dst: str):
    """Convert between wgs84, gcj02 and bd09; BD-09 goes through GCJ-02."""
    names = ("wgs84", "gcj02", "bd09")
    if src not in names or dst not in names:
        raise ValueError(f"datum must be one of {names}")
    if src == dst:
        return lon, lat
    if src == "bd09":
        lon, lat = bd_to_gcj(lon, lat)
        return (lon, lat) if dst == "gcj02" else gcj_to_wgs(lon, lat)
    if src == "wgs84":
        lon, lat = wgs_to_gcj(lon, lat)
        return (lon, lat) if dst == "gcj02" else gcj_to_bd(lon, lat)
    return gcj_to_bd(lon, lat) if dst == "bd09" else gcj_to_wgs(lon, lat)
