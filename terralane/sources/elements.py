"""Features and points of interest from raw map elements.

``elements``: type (node or way), id, lon, lat, nodes ARRAY<LONG>, tags MAP<STRING, STRING>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terralane.functions import geometry as G
from terralane.session import require

POI_KEYS = ("amenity", "tourism", "leisure", "name")


def _way_vertices(elements: DataFrame) -> DataFrame:
    """Way id and its known vertices in order; every way is one element row."""
    require(elements, "type", "id", "lon", "lat", "nodes", "tags")
    nodes = elements.filter(F.col("type") == "node").select(
        F.col("id").alias("nid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    refs = elements.filter(F.col("type") == "way").select("id", F.posexplode("nodes").alias("pos", "nid"))
    placed = refs.join(nodes, "nid")
    return placed.groupBy("id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda v: G.xy(v["x"], v["y"])).alias("path"))


def assemble_ways(elements: DataFrame) -> DataFrame:
    """Polygons of the ways: id, tags, geom and bounds.

    Unknown nodes are skipped; ways with fewer than three vertices or without area are
    dropped; open rings are closed.
    """
    paths = _way_vertices(elements).filter(F.size("path") >= 3)
    first, last = F.col("path")[0], F.element_at("path", -1)
    ring = F.when(first == last, F.col("path")).otherwise(F.concat("path", F.slice("path", 1, 1)))
    rings = paths.select("id", ring.alias("ring")).withColumn("_a", G.ring_signed_area(F.col("ring")))
    rings = rings.filter(F.col("_a") != 0)
    turned = F.when(F.col("_a") > 0, F.col("ring")).otherwise(F.reverse("ring"))
    tags = elements.filter(F.col("type") == "way").select("id", "tags")
    out = rings.select("id", G.geometry("Polygon", F.array(turned)).alias("geom")).join(tags, "id")
    return G.with_bounds(out)


def extract_pois(elements: DataFrame, tags: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Named or tagged places: id, name, address, x, y, tags.

    ``tags`` asks for key = value pairs (``*`` for any value); by default any of the usual
    place keys will do. Polygon places take the mean of the ring vertices, the closing one
    included.
    """
    if tags:
        wanted = F.lit(False)
        for key, value in tags.items():
            hit = F.col("tags")[key].isNotNull() if value == "*" else F.col("tags")[key] == value
            wanted = wanted | F.coalesce(hit, F.lit(False))
    else:
        wanted = F.lit(False)
        for key in POI_KEYS:
            wanted = wanted | F.col("tags")[key].isNotNull()
    points = elements.filter((F.col("type") == "node") & wanted).select(
        "id", F.col("lon").alias("x"), F.col("lat").alias("y"), "tags")
    ring = F.col("geom.rings")[0]
    n = F.size(ring)

    def mean(axis):
        return F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]) / n
    areas = assemble_ways(elements).filter(wanted).select("id", mean("x").alias("x"), mean("y").alias("y"), "tags")
    out = points.unionByName(areas).select(
        "id", F.coalesce(F.col("tags")["name"], F.lit("")).alias("name"),
        F.coalesce(F.col("tags")["addr:street"], F.lit("")).alias("address"), "x", "y", "tags")
    return out.orderBy("id").limit(limit) if limit else out
