"""Searching a scene catalogue and summarising bands over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terralane.session import require


def search_scenes(items: DataFrame, bbox=None, t0: str | None = None, t1: str | None = None,
                  cloud_lt: float | None = None, collection: str | None = None, n: int = 10) -> DataFrame:
    """Newest ``n`` scenes that meet the box, the inclusive dates and the cloud limit."""
    require(items, "id", "datetime", "minx", "miny", "maxx", "maxy")
    out = items
    if bbox is not None:
        x0, y0, x1, y1 = (float(v) for v in bbox)
        out = out.filter((F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0))
    if t0 is not None:
        out = out.filter(F.col("datetime") >= F.lit(t0).cast("timestamp_ntz"))
    if t1 is not None:
        out = out.filter(F.col("datetime") < F.date_add(F.lit(t1).cast("date"), 1).cast("timestamp_ntz"))
    if cloud_lt is not None:
        out = out.filter(F.col("cloud_cover") < cloud_lt)
    if collection is not None:
        out = out.filter(F.col("collection") == collection)
    return out.orderBy(F.col("datetime").desc(), "id").limit(n)


def scene_timeseries(cells: DataFrame, items: DataFrame, band, bbox=None) -> DataFrame:
    """Mean of a band per date: ``cells`` (scene, band, x, y, v) joined with the catalogue."""
    require(cells, "scene", "band", "v")
    one = cells.filter((F.col("band") == band) & F.col("v").isNotNull())
    if bbox is not None:
        x0, y0, x1, y1 = (float(v) for v in bbox)
        one = one.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    # sums per scene first, so that the catalogue join sees one row per scene
    per = one.groupBy("scene").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    dated = per.join(items.select(F.col("id").alias("scene"), F.to_date("datetime").alias("date")), "scene")
    return dated.groupBy("date").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("cells"))
