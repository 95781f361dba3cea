"""Exact nearest and k-nearest joins.

The right side is summarised into a pyramid of grid cells (count and tight bounds per
cell, built by map-side combined aggregates). Left points are searched for together, by
small cells with tight bounds: a left cell keeps the right cells that can still hold one of
the k nearest points of any of its points. A right cell is dropped when its smallest possible
distance exceeds the largest distance of enough closer points. Right cells with few rows are not
divided further, and left cells are as small as the denser side asks for, so a left cell keeps a bounded number of
right cells whatever the sizes of the two sides. The points of a left cell are then compared with those of its right cells at once, in blocks of bounded size, so hot cells
on either side and far clusters cost extra levels or blocks, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from terralane.functions.geometry import EARTH_RADIUS
from terralane.session import cut, require

STEP = 2                    # levels per descent step: 4 x 4 children per cell
FINEST = 24                 # deepest level of the pyramid
LEAF_ROWS = 256             # a leaf cell with more rows than this is split further
FEW_ROWS = 16               # a cell with no more rows is not divided
BROADCAST_ROWS = 300_000    # pyramid levels up to this many rows are broadcast
TOGETHER = 64               # left points per left cell, on average
AROUND = 512                # right points in the extent of a left cell, on average at most
TASK_CELLS = 512            # left cells that one task searches for
TASK_ROWS = 20_000          # left points that one task compares
BLOCK = 1024                # left points compared in one group, on average at most
_PAIRS = 1 << 21            # distances computed at once


def _bounds(metric: str) -> tuple[Column, Column]:
    """Smallest and largest possible distance from the box ax0..ay1 to the box x0..y1."""
    zero = F.lit(0.0)
    c = F.col
    gap_x = F.greatest(zero, c("x0") - c("ax1"), c("ax0") - c("x1"))
    gap_y = F.greatest(zero, c("y0") - c("ay1"), c("ay0") - c("y1"))
    far_x = F.greatest(F.abs(c("x1") - c("ax0")), F.abs(c("ax1") - c("x0")))
    far_y = F.greatest(F.abs(c("y1") - c("ay0")), F.abs(c("ay1") - c("y0")))
    if metric == "euclidean":
        return F.sqrt(gap_x * gap_x + gap_y * gap_y), F.sqrt(far_x * far_x + far_y * far_y)
    # the distance to a meridian bounds the longitude gap; a path along the meridian and
    # then along the parallel bounds the farthest corner
    steepest = F.greatest(F.abs(c("ay0")), F.abs(c("ay1")))
    flattest = F.when((c("ay0") <= 0) & (c("ay1") >= 0), zero).otherwise(F.least(F.abs(c("ay0")), F.abs(c("ay1"))))
    gap_x = F.greatest(zero, F.least(gap_x, F.lit(360.0) - far_x, F.lit(90.0)))
    east_west = F.asin(F.least(F.lit(1.0), F.abs(F.cos(F.radians(steepest))) * F.sin(F.radians(gap_x))))
    near = F.greatest(F.radians(gap_y), east_west)
    far = F.radians(far_y) + F.abs(F.cos(F.radians(flattest))) * F.radians(F.least(far_x, F.lit(180.0)))
    # one part in 1e9 of slack absorbs rounding in the trigonometric bounds
    return near * (EARTH_RADIUS * (1 - 1e-9)), far * (EARTH_RADIUS * (1 + 1e-9)) + 1e-6


def _cell(axis: str, level: int) -> Column:
    return F.shiftright(F.col(axis), FINEST - level)


def _node(level: int) -> Column:
    """Name of a point's cell at a level, or of its undivided cell above it."""
    return F.expr(f"least({level}, leaf) * {1 << 2 * FINEST}L + shiftright(ix, {FINEST} - least({level}, leaf)) * {1 << FINEST}L"
                  f" + shiftright(iy, {FINEST} - least({level}, leaf))")


def _undivided(points: DataFrame, n: int, depth: int) -> DataFrame:
    """The level ``leaf`` of each point's first cell with few rows, ``depth`` at most."""
    levels = F.lit(STEP if depth and n > FEW_ROWS else 0)
    for level in range(STEP, depth, STEP):
        cells = points.groupBy(_cell("ix", level).alias("hx"), _cell("iy", level).alias("hy")).count()
        full = cells.filter(F.col("count") > FEW_ROWS).select(F.col("hx").alias(f"hx{level}"), F.col("hy").alias(f"hy{level}"))
        if min(4**level, n // FEW_ROWS) <= BROADCAST_ROWS:
            full = F.broadcast(full)
        points = points.join(full, (_cell("ix", level) == F.col(f"hx{level}")) & (_cell("iy", level) == F.col(f"hy{level}")), "left")
        levels = levels + F.when(F.col(f"hx{level}").isNotNull(), STEP).otherwise(0)
    return cut(points.select("bid", "bx", "by", "ix", "iy", levels.cast("int").alias("leaf")))


def _pyramid_depth(points: DataFrame, n: int, k: int) -> tuple[DataFrame, int]:
    """Depth at which every leaf is small; coordinates shared by many rows keep k ids."""
    level = STEP * max(0, math.ceil(math.log(max(n / 8.0, 1.0), 4) / STEP))
    limit = max(LEAF_ROWS, 4 * k)
    thinned = False
    while level < FINEST:
        cells = points.groupBy(_cell("ix", level).alias("cx"), _cell("iy", level).alias("cy"))
        worst = cells.count().agg(F.max("count")).first()[0]
        if worst <= limit:
            break
        if not thinned:
            same = W.partitionBy("bx", "by").orderBy("bid")
            points = (points.withColumn("_same", F.row_number().over(same))
                      .filter(F.col("_same") <= k).drop("_same"))
            thinned = True
            continue
        level += STEP
    return points, level


def knn_join(a: DataFrame, b: DataFrame, k: int = 1, max_distance: float | None = None,
             metric: str = "euclidean", a_id: str = "id", b_id: str = "id",
             a_xy=("x", "y"), b_xy=("x", "y"), exclude_self: bool = False) -> DataFrame:
    """The k nearest rows of ``b`` for each row of ``a``; ties go to the lowest id.

    Returns ``a_id, b_id, dist, rank``. ``a_id`` must be unique. Left rows without a
    neighbour (empty right side or beyond ``max_distance``) do not appear.
    With ``exclude_self`` a pair with equal ids is left out (self joins).
    """
    require(a, a_id, *a_xy)
    require(b, b_id, *b_xy)
    if k < 1:
        raise ValueError("k must be at least 1")
    want = k + 1 if exclude_self else k
    left = (a.select(F.col(a_id).alias("aid"), F.col(a_xy[0]).cast("double").alias("ax"),
                     F.col(a_xy[1]).cast("double").alias("ay"))
            .filter(F.col("ax").isNotNull() & F.col("ay").isNotNull()))
    points = (b.select(F.col(b_id).alias("bid"), F.col(b_xy[0]).cast("double").alias("bx"),
                       F.col(b_xy[1]).cast("double").alias("by"))
              .filter(F.col("bx").isNotNull() & F.col("by").isNotNull()))
    return _pyramid_join(left, points, k, want, max_distance, metric, exclude_self)


def _result_schema(left: DataFrame, points: DataFrame) -> str:
    return f"a_id {dict(left.dtypes)['aid']}, b_id {dict(points.dtypes)['bid']}, dist double, rank int"


def _pyramid_join(left: DataFrame, points: DataFrame, k: int, want: int, max_distance: float | None,
                  metric: str, exclude_self: bool) -> DataFrame:
    """Descend the cell pyramid of the right side with the cells of the left side."""
    if metric not in ("euclidean", "haversine"):
        raise ValueError(f"unknown metric {metric!r}; use euclidean or haversine")
    n, x0, y0, x1, y1 = points.agg(F.count("*"), F.min("bx"), F.min("by"),
                                   F.max("bx"), F.max("by")).first()
    m, ax0, ay0, ax1, ay1 = left.agg(F.count("*"), F.min("ax"), F.min("ay"), F.max("ax"), F.max("ay")).first()
    if n == 0 or m == 0:
        return left.sparkSession.createDataFrame([], _result_schema(left, points))
    unit = max(x1 - x0, y1 - y0, 1e-12) * (1 + 1e-9) / 2**FINEST
    top = 2**FINEST - 1
    points = points.withColumns({
        "ix": F.least(F.floor((F.col("bx") - x0) / unit), F.lit(top)).cast("long"),
        "iy": F.least(F.floor((F.col("by") - y0) / unit), F.lit(top)).cast("long")})
    points, depth = _pyramid_depth(points, n, want)
    points = _undivided(points, n, depth)

    wide, high = max(ax1 - ax0, 1e-12), max(ay1 - ay0, 1e-12)
    side = min(math.sqrt(wide * high * TOGETHER / m), math.sqrt(max(x1 - x0, 1e-12) * max(y1 - y0, 1e-12) * AROUND / n))
    side = max(side, max(wide, high) / 2**30)
    shuffled = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    searching = max(shuffled, math.ceil(min(m, (wide // side + 1) * (high // side + 1)) / TASK_CELLS))
    comparing = max(shuffled, math.ceil(m / TASK_ROWS))
    left = left.withColumns({"lx": F.floor((F.col("ax") - ax0) / side).cast("long"),
                             "ly": F.floor((F.col("ay") - ay0) / side).cast("long")})
    cells = left.groupBy("lx", "ly").agg(
        F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.min("ax").alias("ax0"), F.max("ax").alias("ax1"),
        F.min("ay").alias("ay0"), F.max("ay").alias("ay1"))
    # stated numbers of tasks: adaptive execution would merge cells by their bytes, and each grows to hundreds of rows
    cells = cells.repartition(searching, "lx", "ly")
    box = ["lx", "ly", "blocks", "ax0", "ax1", "ay0", "ay1"]
    q = cells.withColumn("cell", F.lit(0).cast("long"))
    near, far = _bounds(metric)
    closest = W.partitionBy("lx", "ly").orderBy("far", "node").rowsBetween(W.unboundedPreceding, W.currentRow)
    for level in range(STEP, depth + 1, STEP):
        nodes = (points.groupBy(_node(level).alias("node"), _node(level - STEP).alias("parent"))
                 .agg(F.count("*").alias("cnt"), F.min("bx").alias("x0"), F.max("bx").alias("x1"),
                      F.min("by").alias("y0"), F.max("by").alias("y1")))
        if min(4**level, n) <= BROADCAST_ROWS:
            nodes = F.broadcast(nodes)
        q = q.join(nodes, q.cell == nodes.parent).select(*box, "node", "cnt", near.alias("near"), far.alias("far"))
        if max_distance is not None:
            q = q.filter(F.col("near") <= max_distance)
        # the least distance within which enough points lie for every point of the left cell
        q = q.withColumn("have", F.sum("cnt").over(closest))
        q = q.withColumn("reach", F.min(F.when(F.col("have") >= want, F.col("far"))).over(W.partitionBy("lx", "ly")))
        q = q.filter(F.col("reach").isNull() | (F.col("near") <= F.col("reach"))).select(*box, F.col("node").alias("cell"))

    leaves = points.select("bid", "bx", "by", _node(depth).alias("node"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    right = q.join(leaves, q.cell == leaves.node).select(
        F.col("lx").alias("rx"), F.col("ly").alias("ry"), block.alias("rb"), "bid", "bx", "by")
    sizes = cells.select("lx", "ly", "blocks")
    own = left.join(sizes, ["lx", "ly"]).select("lx", "ly", F.pmod(F.xxhash64("aid"), F.col("blocks")).alias("block"), "aid", "ax", "ay")
    own, right = own.repartition(comparing, "lx", "ly", "block"), right.repartition(comparing, "rx", "ry", "rb")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _nearest_of(a, b, k, max_distance, metric, exclude_self)

    return own.groupBy("lx", "ly", "block").cogroup(right.groupBy("rx", "ry", "rb")).applyInPandas(compare, _result_schema(left, points))


def _distances(metric: str, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    ax, ay, bx, by = (np.radians(c) for c in (ax, ay, bx, by))
    s1, s2 = np.sin((by - ay) / 2), np.sin((bx - ax) / 2)
    h = s1 * s1 + np.cos(ay) * np.cos(by) * s2 * s2
    return 2.0 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def _nearest_of(a: pd.DataFrame, b: pd.DataFrame, k: int, max_distance: float | None, metric: str, exclude_self: bool) -> pd.DataFrame:
    """The k nearest rows of one block of right points for each row of one block of left points; ties to the lowest id."""
    b = b.sort_values("bid", kind="stable")
    aid, bid = a["aid"].to_numpy(), b["bid"].to_numpy()
    ax, ay, bx, by = (c.to_numpy(float) for c in (a["ax"], a["ay"], b["bx"], b["by"]))
    out = [(aid[:0], bid[:0], np.zeros(0), np.zeros(0, np.int32))]
    step = max(1, _PAIRS // max(1, len(b)))
    for at in range(0, len(a) if len(b) else 0, step):
        part = slice(at, at + step)
        d = _distances(metric, ax[part, None], ay[part, None], bx[None], by[None])
        if exclude_self:
            d[aid[part, None] == bid[None]] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if len(b) > k else np.full(len(d), np.inf)
        row, col = np.nonzero((d <= last[:, None]) & (d < np.inf) & (d <= (np.inf if max_distance is None else max_distance)))
        dist = d[row, col]
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        first = np.searchsorted(row, row)
        rank = np.arange(len(row)) - first
        kept = rank < k
        out.append((aid[part][row[kept]], bid[col[kept]], dist[kept], (rank[kept] + 1).astype(np.int32)))
    a_id, b_id, dist, rank = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"a_id": a_id, "b_id": b_id, "dist": dist, "rank": rank})


def nearest_join(a: DataFrame, b: DataFrame, max_distance: float | None = None,
                 metric: str = "euclidean", a_id: str = "id", b_id: str = "id",
                 suffix: str = "_near") -> DataFrame:
    """Each left row with the attributes of its closest right row and ``nearest_dist``.

    Left rows without a match are dropped; right columns get ``suffix`` on a name clash.
    """
    pairs = knn_join(a, b, 1, max_distance, metric, a_id, b_id)
    renamed = b.select([F.col(c).alias(c + suffix if c in a.columns else c) for c in b.columns])
    b_key = b_id + suffix if b_id in a.columns else b_id
    return (a.join(pairs, a[a_id] == pairs.a_id)
            .join(renamed, F.col("b_id") == renamed[b_key])
            .withColumnRenamed("dist", "nearest_dist").drop("a_id", "b_id", "rank"))
