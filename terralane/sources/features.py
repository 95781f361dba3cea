"""Reading and writing feature, point and raster layers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from terralane.functions import geometry as G
from terralane.operators.measures import infer_epsg
from terralane.session import require

# Column names accepted as coordinates, in order of preference.
LON_NAMES = ("lon", "x", "longitude", "lng")
LAT_NAMES = ("lat", "y", "latitude")
FORMATS = ("parquet", "json", "csv", "orc", "geojson")
WKB_KINDS = {"Point": 1, "LineString": 2, "Polygon": 3}
COORDS = {
    "Point": "array<double>", "MultiPoint": "array<array<double>>", "LineString": "array<array<double>>",
    "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>",
    "MultiPolygon": "array<array<array<array<double>>>>",
}


def _path(points):
    return F.transform(points, lambda p: G.xy(p[0], p[1]))


def _oriented(ring, ccw: bool):
    """Turn a closed ring to the wanted direction."""
    area = G.ring_signed_area(ring)
    return F.when((area >= 0) if ccw else (area <= 0), ring).otherwise(F.reverse(ring))


def _polygon_rings(rings):
    """Outer ring counter-clockwise, holes clockwise."""
    return F.transform(rings, lambda r, i: F.when(i == 0, _oriented(_path(r), True))
                       .otherwise(_oriented(_path(r), False)))


def parse_geojson(geometry_json):
    """Geometry struct from a GeoJSON geometry text (null for unknown kinds)."""
    kind = F.get_json_object(geometry_json, "$.type")
    text = F.get_json_object(geometry_json, "$.coordinates")

    def coords(name):
        return F.from_json(text, COORDS[name])
    rings = (F.when(kind == "Point", F.array(F.array(G.xy(coords("Point")[0], coords("Point")[1]))))
             .when(kind == "MultiPoint", F.transform(coords("MultiPoint"), lambda p: F.array(G.xy(p[0], p[1]))))
             .when(kind == "LineString", F.array(_path(coords("LineString"))))
             .when(kind == "MultiLineString", F.transform(coords("MultiLineString"), _path))
             .when(kind == "Polygon", _polygon_rings(coords("Polygon")))
             .when(kind == "MultiPolygon", F.flatten(F.transform(coords("MultiPolygon"), _polygon_rings))))
    return F.when(rings.isNotNull(), F.struct(kind.alias("type"), rings.alias("rings")))


def _read_geojson(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Features of FeatureCollection files, or of files with one feature per line."""
    if lines:
        one = "type string, geometry string, properties map<string,string>"
        feats = spark.read.schema(one).json(path)
    else:
        whole = "features array<struct<geometry:string,properties:map<string,string>>>"
        feats = spark.read.schema(whole).option("multiLine", True).json(path).select(
            F.explode("features").alias("f")).select("f.geometry", "f.properties")
    return feats.select(parse_geojson(F.col("geometry")).alias("geom"), "properties")


def load_features(spark: SparkSession, path: str, fmt: str = "parquet", crs: int | None = None,
                  properties: str | None = None) -> DataFrame:
    """Load a vector layer with bounds and ``srid`` (inferred from the extent when missing).

    ``fmt``: parquet (struct or WKB ``geom``), geojson, geojsonl (one feature per line).
    ``properties`` is a DDL list that turns GeoJSON properties into typed columns.
    """
    if fmt in ("geojson", "geojsonl"):
        df = _read_geojson(spark, path, fmt == "geojsonl")
        if properties:
            fields = [p.strip().split(None, 1) for p in properties.split(",")]
            df = df.select("geom", *[F.col("properties")[n].cast(t).alias(n) for n, t in fields])
    elif fmt == "parquet":
        df = spark.read.parquet(path)
        require(df, "geom")
        if dict(df.dtypes)["geom"] == "binary":
            df = df.withColumn("geom", geometry_from_wkb("geom"))
    else:
        raise ValueError(f"unknown format {fmt!r}; use parquet, geojson or geojsonl")
    if "minx" not in df.columns:
        df = G.with_bounds(df)
    if "srid" in df.columns and crs is None:
        return df
    return df.withColumn("srid", F.lit(infer_epsg(df) if crs is None else crs))


def load_points_csv(spark: SparkSession, path: str, value: str | None = None) -> DataFrame:
    """Point table from CSV: coordinate columns by name, rows with nulls dropped."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    by_name = {c.lower(): c for c in df.columns}
    x = next((by_name[n] for n in LON_NAMES if n in by_name), None)
    y = next((by_name[n] for n in LAT_NAMES if n in by_name), None)
    if x is None or y is None:
        raise ValueError(f"no coordinate columns among {df.columns}")
    out = df.withColumnsRenamed({x: "x", y: "y"})
    out = out.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    if value is not None:
        require(out, value)
    return out.dropna(subset=["x", "y"] + ([value] if value else []))


def _wkb_bytes(geom: dict | None) -> bytes | None:
    """Little-endian WKB; several polygon rings are one polygon with holes."""
    if geom is None:
        return None
    kind, rings = geom["type"], geom["rings"]

    def points(path):
        return struct.pack(f"<{2 * len(path)}d", *[v for p in path for v in (p["x"], p["y"])])

    def single(name, parts):
        head = struct.pack("<BI", 1, WKB_KINDS[name])
        if name == "Point":
            return head + points(parts[0])
        if name == "LineString":
            return head + struct.pack("<I", len(parts[0])) + points(parts[0])
        return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(r)) + points(r) for r in parts)
    if not kind.startswith("Multi"):
        return single(kind, rings)
    name = kind[5:]
    parts: list[list] = []
    for r in rings:      # a clockwise ring is a hole of the polygon before it
        hole = name == "Polygon" and parts and _turns_clockwise(r)
        parts[-1].append(r) if hole else parts.append([r])
    return struct.pack("<BII", 1, WKB_KINDS[name] + 3, len(parts)) + b"".join(single(name, p) for p in parts)


def _turns_clockwise(ring) -> bool:
    return sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring, ring[1:])) < 0


def _from_wkb_bytes(data: bytes | None) -> dict | None:
    if data is None:
        return None
    names = {n: k for k, n in WKB_KINDS.items()}

    def read(at):
        order = "<" if data[at] else ">"
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5

        def path(at, n):
            v = struct.unpack_from(f"{order}{2 * n}d", data, at)
            return [{"x": v[i], "y": v[i + 1]} for i in range(0, 2 * n, 2)], at + 16 * n
        if code == 1:
            p, at = path(at, 1)
            return "Point", [p], at
        if code in (2, 3):
            n = struct.unpack_from(order + "I", data, at)[0]
            at += 4
            if code == 2:
                p, at = path(at, n)
                return "LineString", [p], at
            rings = []
            for _ in range(n):
                m = struct.unpack_from(order + "I", data, at)[0]
                r, at = path(at + 4, m)
                rings.append(r)
            return "Polygon", rings, at
        if code in (4, 5, 6):
            n = struct.unpack_from(order + "I", data, at)[0]
            at += 4
            rings = []
            for _ in range(n):
                _, part, at = read(at)
                rings += part
            return "Multi" + names[code - 3], rings, at
        raise ValueError(f"unsupported WKB geometry code {code}")
    kind, rings, _ = read(0)
    return {"type": kind, "rings": rings}


def to_wkb(geom: str = "geom"):
    """Binary column of a geometry column, converted by Arrow batches."""
    @F.pandas_udf("binary")
    def convert(g: pd.DataFrame) -> pd.Series:
        return pd.Series([_wkb_bytes({"type": t, "rings": r}) if t is not None else None
                          for t, r in zip(g["type"], g["rings"])])
    return convert(F.col(geom))


def geometry_from_wkb(geom: str = "geom"):
    """Geometry column of a WKB column, with ring directions set."""
    @F.pandas_udf(G.GEOM_TYPE)
    def convert(data: pd.Series) -> pd.DataFrame:
        out = [_from_wkb_bytes(bytes(b)) if b is not None else {"type": None, "rings": None} for b in data]
        return pd.DataFrame({"type": [o["type"] for o in out], "rings": [o["rings"] for o in out]})
    return convert(F.col(geom))


def _geojson_geometry(g):
    """GeoJSON geometry struct; coordinates are given as JSON text per kind."""
    def pair(p):
        return F.array(p["x"], p["y"])
    paths = F.transform(g["rings"], lambda r: F.transform(r, pair))
    text = (F.when(g["type"] == "Point", F.to_json(paths[0][0])).when(g["type"] == "MultiPoint", F.to_json(F.flatten(paths)))
            .when(g["type"] == "LineString", F.to_json(paths[0])).when(g["type"] == "MultiPolygon", F.to_json(_grouped(g["rings"])))
            .otherwise(F.to_json(paths)))
    return F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), text, F.lit("}"))


def _grouped(rings):
    """Rings of a multi-polygon as polygons: a counter-clockwise ring opens a new one."""
    empty = F.array().cast("array<array<array<array<double>>>>")

    def step(acc, r):
        path = F.transform(r, lambda p: F.array(p["x"], p["y"]))
        last = F.size(acc)
        opens = (G.ring_signed_area(r) >= 0) | (last == 0)
        grown = F.concat(F.slice(acc, 1, F.greatest(last - 1, F.lit(0))),
                         F.array(F.concat(F.element_at(acc, -1), F.array(path))))
        return F.when(opens, F.concat(acc, F.array(F.array(path)))).otherwise(grown)
    return F.aggregate(rings, empty, step)


def load_cells(spark: SparkSession, path: str, nodata: float | None = None,
               grid_path: str | None = None) -> tuple[DataFrame, dict]:
    """Cell table and its grid; values equal to ``nodata`` become null.

    The grid comes from ``grid_path`` (a one-row table) or is unit cells over the extent.
    """
    cells = spark.read.parquet(path)
    require(cells, "r", "c", "v")
    if nodata is not None:
        cells = cells.withColumn("v", F.when(F.col("v") != nodata, F.col("v")))
    cells = cells.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    cells = cells.drop("tile_row")
    if grid_path:
        return cells, spark.read.parquet(grid_path).first().asDict()
    rows, cols = cells.agg(F.max("r") + 1, F.max("c") + 1).first()
    return cells, {"x0": 0.0, "y0": 0.0, "dx": 1.0, "dy": 1.0, "rows": rows, "cols": cols, "srid": 3857}


def write_features(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None,
                   mode: str = "errorifexists", wkb: bool = False) -> None:
    """Write a layer; GeoJSON is one feature per line so that it stays parallel.

    ``wkb`` stores the geometry as well-known binary (the usual parquet interchange form).
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {FORMATS}")
    if fmt == "geojson":
        props = [c for c in df.columns if c not in ("geom", "minx", "miny", "maxx", "maxy")]
        line = F.concat(F.lit('{"type":"Feature","geometry":'), _geojson_geometry(F.col("geom")),
                        F.lit(',"properties":'), F.to_json(F.struct(*props)) if props else F.lit("{}"), F.lit("}"))
        df.select(line.alias("value")).write.mode(mode).text(path)
        return
    out = df
    if wkb:
        out = out.withColumn("geom", to_wkb("geom"))
    if fmt == "csv":      # nested columns travel as JSON text
        out = df.select([F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c)
                         for c, t in df.dtypes])
    writer = out.write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    if fmt == "csv":
        writer = writer.option("header", True)
    getattr(writer, fmt)(path)


def write_cells(cells: DataFrame, path: str, rows_per_tile: int = 1024, mode: str = "errorifexists",
                nodata: float | None = None) -> None:
    """Write a raster partitioned by band and row band, so that reads prune partitions."""
    out = cells if "band" in cells.columns else cells.withColumn("band", F.lit(1))
    if nodata is not None:
        out = out.withColumn("v", F.coalesce("v", F.lit(float(nodata))))
    out = out.withColumn("tile_row", F.floor(F.col("r") / rows_per_tile))
    (out.repartition("band", "tile_row").sortWithinPartitions("r", "c")
     .write.mode(mode).partitionBy("band", "tile_row").parquet(path))


def split_layer(df: DataFrame, path: str, by: str, mode: str = "errorifexists") -> None:
    """One folder per value of a field."""
    require(df, by)
    df.write.mode(mode).partitionBy(by).parquet(path)


def convert_layers(spark: SparkSession, in_glob: str, out: str, fmt: str = "parquet",
                   source: str = "geojson") -> DataFrame:
    """Convert every file of a pattern and report file, features and status.

    All files are read as one job; rows keep their file name and land in one folder per file.
    """
    if source == "geojson":
        whole = "features array<struct<geometry:string,properties:map<string,string>>>"
        raw = spark.read.schema(whole).option("multiLine", True).json(in_glob)
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
        files = raw.select(name.alias("layer"), F.coalesce(F.size("features"), F.lit(0)).alias("n"), "features")
        rows = files.select("layer", F.explode("features").alias("f")).select(
            "layer", parse_geojson(F.col("f.geometry")).alias("geom"), F.col("f.properties").alias("properties"))
    elif source in ("parquet", "csv", "json", "orc"):
        reader = spark.read.option("header", True).option("inferSchema", True) if source == "csv" else spark.read
        raw = getattr(reader, source)(in_glob)
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
        rows = raw.withColumn("layer", name)
        files = rows.select("layer", F.lit(1).alias("n"))
    else:
        raise ValueError(f"unknown source format {source!r}")
    if fmt not in ("parquet", "json", "orc"):
        raise ValueError("the target format must be parquet, json or orc")
    getattr(rows.write.mode("errorifexists").partitionBy("layer"), fmt)(out)
    count = files.groupBy("layer").agg(F.sum("n").cast("long").alias("features"))
    return count.withColumn("status", F.when(F.col("features") > 0, "converted").otherwise("empty"))
