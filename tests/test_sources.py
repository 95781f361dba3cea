"""Files in, files out, errors that name the problem, and streaming use."""

import json

import pytest
from pyspark.sql import functions as F

from terralane.functions import geometry as G
from terralane.operators import measures as M
from terralane.operators import raster as R
from terralane.operators import spatialstats as S
from terralane.sources import database as D
from terralane.sources import features as L
from terralane.streaming import stateless


def geojson(tmp_path, name="layer.geojson", shift=0):
    feats = [
        {"type": "Feature", "properties": {"name": "p", "n": 1}, "geometry": {"type": "Point", "coordinates": [1 + shift, 2]}},
        {"type": "Feature", "properties": {"name": "l", "n": 2}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}},
        {"type": "Feature", "properties": {"name": "h", "n": 3}, "geometry": {"type": "Polygon", "coordinates": [
            [[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}},
        {"type": "Feature", "properties": {"name": "m", "n": 4}, "geometry": {"type": "MultiPolygon", "coordinates": [
            [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]], [[[5, 5], [7, 5], [7, 7], [5, 7], [5, 5]]]]}},
    ]
    path = tmp_path / name
    path.write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    return str(path)


def areas(df):
    return {r["name"]: r["area"] for r in M.measure_area(df, "sqdeg").collect()}


def test_geojson_kinds(spark, tmp_path):
    df = L.load_features(spark, geojson(tmp_path), "geojson", properties="name string, n int")
    assert areas(df) == {"p": 0, "l": 0, "h": 15, "m": 5}
    assert {r["srid"] for r in df.collect()} == {4326}
    lengths = {r["name"]: r["length"] for r in M.measure_length(df, "deg").collect()}
    assert lengths["l"] == 5
    far = L.load_features(spark, geojson(tmp_path, shift=1000), "geojson")
    assert far.first()["srid"] == 3857


@pytest.mark.parametrize("wkb", [False, True])
def test_parquet_round_trip(spark, tmp_path, wkb):
    df = L.load_features(spark, geojson(tmp_path), "geojson", properties="name string, n int")
    out = str(tmp_path / "out")
    L.write_features(df, out, compression="gzip", wkb=wkb)
    back = L.load_features(spark, out)
    assert areas(back) == areas(df)
    assert {r["name"]: r["geom"]["type"] for r in back.collect()} == {"p": "Point", "l": "LineString", "h": "Polygon", "m": "MultiPolygon"}


def test_geojson_lines_round_trip(spark, tmp_path):
    df = L.load_features(spark, geojson(tmp_path), "geojson", properties="name string, n int")
    out = str(tmp_path / "lines")
    L.write_features(df, out, "geojson")
    back = L.load_features(spark, out, "geojsonl", properties="name string, n int")
    assert areas(back) == areas(df)


def test_convert_reports_empty_files(spark, tmp_path):
    geojson(tmp_path, "a.geojson")
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    got = L.convert_layers(spark, str(tmp_path / "*.geojson"), str(tmp_path / "out"))
    assert {(r["layer"], r["features"], r["status"]) for r in got.collect()} == {("a", 4, "converted"), ("b", 0, "empty")}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_csv_aliases(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,LNG,Latitude,v\na,1,2,3\nb,,2,3\nc,1,2,\n")
    assert L.load_points_csv(spark, str(tmp_path / "p.csv"), "v").count() == 1
    assert L.load_points_csv(spark, str(tmp_path / "p.csv")).count() == 2
    (tmp_path / "q.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="coordinate columns"):
        L.load_points_csv(spark, str(tmp_path / "q.csv"))


def test_cells_are_pruned_by_partition(spark, tmp_path):
    cells = spark.range(400).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"), F.rand(1).alias("v"))
    out = str(tmp_path / "cells")
    L.write_cells(cells, out, rows_per_tile=5)
    plan = spark.read.parquet(out).filter("tile_row = 2 and band = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan
    back, grid = L.load_cells(spark, out)
    assert back.count() == 400 and (grid["rows"], grid["cols"]) == (20, 20)


def test_errors_are_early(spark, points, boxes):
    pts = points([(0, 0)])
    for call in (lambda: M.select_by_attribute(pts, "nope", "=", 1), lambda: M.select_by_attribute(pts, "x", "~", 1),
                 lambda: M.reproject_layer(pts, 4326, 9999), lambda: M.measure_area(boxes([(0, 0, 1, 1)]), "acre"),
                 lambda: D.jdbc_read(spark, "jdbc:none", "a; drop table b"), lambda: D.jdbc_write(pts, "jdbc:none", "t", "maybe"),
                 lambda: L.write_features(pts, "/tmp/never", "shp"), lambda: R.reclassify(pts, [], closed="both"),
                 lambda: S.morans_i(pts, "nope", pts)):
        with pytest.raises(ValueError):
            call()


def test_stateless_stream(spark, tmp_path):
    src, out, mark = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "mark")
    spark.range(50).select("id", (F.col("id") * 0.1 + 100).alias("x"), F.lit(30.0).alias("y")).write.parquet(src)
    query = stateless.run_layer_stream(
        spark, src, "id long, x double, y double", out, mark,
        lambda df: M.convert_datum(M.bbox_filter(df, (101, 29, 103, 31)), "wgs84", "gcj02"))
    query.awaitTermination(120)
    got = spark.read.parquet(out)
    want = M.convert_datum(M.bbox_filter(spark.read.parquet(src), (101, 29, 103, 31)), "wgs84", "gcj02")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="stateless"):
        stateless.run_layer_stream(spark, src, "id long, x double, y double", out, mark, lambda df: df.groupBy("id").count())


def test_geometry_type_matches_the_struct(boxes):
    assert dict(boxes([(0, 0, 1, 1)]).dtypes)["geom"] == G.GEOM_TYPE
