"""Spatial joins through grid-cell equality followed by the exact test."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from terralane.functions import geometry as G
from terralane.operators.nearest import _distances, knn_join
from terralane.session import require, spread

MIN_BOX = 1e-9              # boxes are never placed on a level finer than this
STRETCH_SECONDS = 86_400     # time span of a track matched together
LANDMARKS = 1024            # landmarks of a dense distance matrix in one block
LISTED = 1_000_000          # landmarks up to this number are broadcast
NEAR_BLOCK = 16_384         # points of either side compared in one group, on average at most
_PAIRS = 1 << 20            # distances computed at once
BOX = ("minx", "miny", "maxx", "maxy")


def _box_level(prefix: str = "") -> Column:
    """Power-of-two cell size that is at least the box size, as an exponent."""
    size = F.greatest(F.col(prefix + "maxx") - F.col(prefix + "minx"),
                      F.col(prefix + "maxy") - F.col(prefix + "miny"), F.lit(MIN_BOX))
    return F.ceil(F.log2(size)).cast("int")


def _levels(df: DataFrame) -> list[int]:
    """Distinct cell levels of a layer: at most one per power of two."""
    return sorted(r[0] for r in df.select(_box_level().alias("l")).distinct().collect())


def _keyed(df: DataFrame, own: bool, other_levels: list[int]) -> DataFrame:
    """Add grid keys: up to four cells on the own level and on each coarser level of the
    other side."""
    lvl = F.col("_lvl") if own else F.lit(-2000)
    probes = F.filter(F.array(*[F.lit(x) for x in other_levels]).cast("array<int>"),
                      lambda x: x > lvl)
    slots = F.transform(probes, lambda x: F.struct(x.alias("l"), F.lit(False).alias("o")))
    if own:
        slots = F.concat(F.array(F.struct(lvl.alias("l"), F.lit(True).alias("o"))), slots)

    def span(lo, hi, s):
        size = F.pow(F.lit(2.0), s["l"])
        return F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))

    cells = F.flatten(F.transform(slots, lambda s: F.flatten(F.transform(
        span("minx", "maxx", s), lambda cx: F.transform(
            span("miny", "maxy", s), lambda cy: F.struct(
                s["l"].alias("l"), s["o"].alias("o"), cx.alias("cx"), cy.alias("cy")))))))
    return df.withColumn("_k", F.explode(cells)).select(
        *df.columns, F.col("_k.l").alias("_kl"), F.col("_k.o").alias("_ko"),
        F.col("_k.cx").alias("_kx"), F.col("_k.cy").alias("_ky"))


def bbox_pairs(a: DataFrame, b: DataFrame, a_is_points: bool = False) -> DataFrame:
    """All pairs of rows whose bounding boxes meet, each exactly once.

    Columns of ``a`` come prefixed ``a_`` and those of ``b`` ``b_``. Boxes live on the grid
    level of their own size, so neither a huge nor a tiny box explodes into many cells.
    A pair is kept only in the cell of the lower-left corner of the common box.
    """
    la = [] if a_is_points else _levels(a)
    lb = _levels(b)
    left = a if a_is_points else a.withColumn("_lvl", _box_level())
    right = b.withColumn("_lvl", _box_level())
    left = _keyed(left, not a_is_points, lb)
    right = _keyed(right, True, la)
    left = left.select([F.col(c).alias("a_" + c) for c in left.columns])
    right = right.select([F.col(c).alias("b_" + c) for c in right.columns])
    size = F.pow(F.lit(2.0), F.col("a__kl"))
    cond = ((F.col("a__kl") == F.col("b__kl")) & (F.col("a__kx") == F.col("b__kx"))
            & (F.col("a__ky") == F.col("b__ky")) & (F.col("a__ko") | F.col("b__ko"))
            & (F.col("a_minx") <= F.col("b_maxx")) & (F.col("b_minx") <= F.col("a_maxx"))
            & (F.col("a_miny") <= F.col("b_maxy")) & (F.col("b_miny") <= F.col("a_maxy"))
            & (F.floor(F.greatest("a_minx", "b_minx") / size) == F.col("a__kx"))
            & (F.floor(F.greatest("a_miny", "b_miny") / size) == F.col("a__ky")))
    drop = [c for c in left.columns + right.columns if c[2:] in ("_kl", "_ko", "_kx", "_ky", "_lvl")]
    return left.join(right, cond).drop(*drop)


def point_boxes(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Give a point layer the degenerate boxes the pair join works on."""
    return points.withColumns({"minx": F.col(x), "maxx": F.col(x), "miny": F.col(y),
                               "maxy": F.col(y)})


def points_in_polygons(points: DataFrame, polygons: DataFrame, boundary: bool = True) -> DataFrame:
    """Pairs (a_* point, b_* polygon) with the point covered by the polygon.

    Layers without a ``geom`` column are taken as plain boxes.
    """
    if "geom" in polygons.columns:
        polygons = polygons.withColumn("_box", G.is_own_box(F.col("geom"), *[F.col(c) for c in BOX]))
    pairs = bbox_pairs(point_boxes(points), polygons, a_is_points=True)
    if "geom" in polygons.columns:
        test = G.covers_point if boundary else G.contains_point
        exact = test(F.col("b_geom"), F.col("a_x"), F.col("a_y"))
        # a polygon that is its own bounding box needs no ring walk
        pairs = pairs.filter(F.col("b__box") | exact if boundary else exact).drop("b__box")
    elif not boundary:
        pairs = pairs.filter((F.col("a_x") > F.col("b_minx")) & (F.col("a_x") < F.col("b_maxx"))
                             & (F.col("a_y") > F.col("b_miny")) & (F.col("a_y") < F.col("b_maxy")))
    return pairs


def related_pairs(a: DataFrame, b: DataFrame, predicate: str) -> DataFrame:
    """a_id, b_id of the feature pairs that meet a predicate.

    Vertices and edges are unfolded once per feature. Two features that are their own
    bounding boxes are decided by comparing the boxes.
    """
    def slim(df):
        bounds = [F.col(c) for c in BOX]
        flat = G.is_polygon(F.col("geom")) & G.is_own_box(F.col("geom"), *bounds)
        return df.select("id", G.prepare(F.col("geom")).alias("g"), flat.alias("flat"), *BOX)
    pairs = bbox_pairs(slim(a), slim(b))
    ax0, ay0, ax1, ay1 = (F.col("a_" + c) for c in BOX)
    bx0, by0, bx1, by1 = (F.col("b_" + c) for c in BOX)
    overlap = (ax0 < bx1) & (bx0 < ax1) & (ay0 < by1) & (by0 < ay1)
    boxes = {"intersects": F.lit(True), "crosses": F.lit(False), "touches": ~overlap,
             "within": (ax0 >= bx0) & (ax1 <= bx1) & (ay0 >= by0) & (ay1 <= by1),
             "contains": (bx0 >= ax0) & (bx1 <= ax1) & (by0 >= ay0) & (by1 <= ay1)}[predicate]
    exact = G.PREDICATES[predicate](F.col("a_g"), F.col("b_g"))
    both = F.col("a_flat") & F.col("b_flat")
    return pairs.filter(F.when(both, boxes).otherwise(exact)).select("a_id", "b_id")


def spatial_join(a: DataFrame, b: DataFrame, predicate: str = "intersects",
                 how: str = "inner", suffixes=("target", "join"), a_id: str = "id",
                 b_id: str = "id") -> DataFrame:
    """Join two feature layers on a geometric predicate.

    Columns that occur on both sides get ``_target`` / ``_join``. ``how`` is inner, left,
    right or full; unmatched rows keep nulls on the other side.
    """
    if predicate not in G.PREDICATES:
        raise ValueError(f"unknown predicate {predicate!r}; use one of {sorted(G.PREDICATES)}")
    if how not in ("inner", "left", "right", "full"):
        raise ValueError("how must be inner, left, right or full")
    require(a, a_id, "geom", *BOX)
    require(b, b_id, "geom", *BOX)
    pairs = (related_pairs(a.withColumnRenamed(a_id, "id"), b.withColumnRenamed(b_id, "id"), predicate)
             .select(F.col("a_id").alias("_a"), F.col("b_id").alias("_b")))
    both = set(a.columns) & set(b.columns)
    left = a.select([F.col(c).alias(f"{c}_{suffixes[0]}" if c in both else c) for c in a.columns])
    right = b.select([F.col(c).alias(f"{c}_{suffixes[1]}" if c in both else c) for c in b.columns])
    ka = f"{a_id}_{suffixes[0]}" if a_id in both else a_id
    kb = f"{b_id}_{suffixes[1]}" if b_id in both else b_id
    keep_left = "left" if how in ("left", "full") else "inner"
    out = left.join(pairs, left[ka] == pairs._a, keep_left)
    return out.join(right, out._b == right[kb],
                    {"inner": "inner", "left": "left", "right": "right", "full": "full"}[how]
                    ).drop("_a", "_b")


def spatial_join_agg(target: DataFrame, points: DataFrame, stats: dict[str, tuple[str, str]],
                     key: str = "id") -> DataFrame:
    """Statistics of the points inside each target polygon.

    ``stats`` maps an output name to (function, column), e.g. ``{"people": ("sum", "pop")}``;
    ``("count", "*")`` counts. Targets without points give a count of 0 and null statistics.
    """
    pairs = points_in_polygons(points, target)
    aggs = []
    for name, (fn, column) in stats.items():
        src = F.lit(1) if column == "*" else F.col("a_" + column)
        aggs.append(getattr(F, fn)(src).alias(name))
    found = pairs.groupBy(F.col("b_" + key).alias("_key")).agg(*aggs)
    out = target.join(found, target[key] == found._key, "left").drop("_key")
    counts = [n for n, (fn, _) in stats.items() if fn == "count"]
    return out.fillna(0, subset=counts) if counts else out


def select_by_location(df: DataFrame, ref: DataFrame, relation: str = "intersects",
                       key: str = "id") -> DataFrame:
    """Rows of a point or feature layer that relate to any reference feature.

    A point intersects a polygon that covers it, is within one that holds it in its interior, and touches
    one on whose rim it lies; it contains and crosses none.
    """
    if relation not in G.PREDICATES:
        raise ValueError(f"unknown relation {relation!r}; use one of {sorted(G.PREDICATES)}")
    require(df, key)
    require(ref, *BOX)
    if "geom" in df.columns:
        require(ref, "geom")
        pairs = related_pairs(df.withColumnRenamed(key, "id"), ref.withColumn("id", F.lit(0)), relation)
    else:
        if relation in ("contains", "crosses"):
            return df.filter(F.lit(False))
        cols = [c for c in ("geom",) if c in ref.columns]
        pairs = points_in_polygons(df.select(F.col(key).alias("id"), "x", "y"),
                                   ref.select(*cols, *BOX), boundary=relation != "within")
        if relation == "touches":
            x, y = F.col("a_x"), F.col("a_y")
            inside = (G.contains_point(F.col("b_geom"), x, y) if cols else
                      (x > F.col("b_minx")) & (x < F.col("b_maxx")) & (y > F.col("b_miny")) & (y < F.col("b_maxy")))
            pairs = pairs.filter(~inside)
    return df.join(pairs.select(F.col("a_id").alias(key)), key, "left_semi")


def proximity_filter(df: DataFrame, ref: DataFrame, d: float, mode: str = "within",
                     metric: str = "haversine", key: str = "id") -> DataFrame:
    """Points within, or outside, distance ``d`` of any reference point.

    Uses the bounded nearest join, so a dense reference cluster is never paired whole.
    """
    if mode not in ("within", "outside"):
        raise ValueError("mode must be within or outside")
    ref = ref.withColumn("_rid", F.lit(0)).select("_rid", "x", "y").distinct()
    near = knn_join(df, ref, 1, d, metric, a_id=key, b_id="_rid").select(F.col("a_id").alias(key))
    return df.join(near, key, "left_semi" if mode == "within" else "left_anti")


def proximity_counts(df: DataFrame, ref: DataFrame, d: float, metric: str = "haversine",
                     key: str = "id") -> DataFrame:
    """Input, kept and dropped counts of the proximity filter in one pass."""
    ref = ref.withColumn("_rid", F.lit(0)).select("_rid", "x", "y").distinct()
    near = knn_join(df, ref, 1, d, metric, a_id=key, b_id="_rid").select(F.col("a_id").alias("_n"))
    return (df.join(near, df[key] == near._n, "left")
            .agg(F.count("*").alias("input_count"), F.count("_n").alias("kept_count"),
                 (F.count("*") - F.count("_n")).alias("dropped_count")))


def _distance_cells(metric: str, d: float, a: DataFrame, b: DataFrame) -> tuple[float, float]:
    """Cell sizes such that a 3 x 3 neighbourhood covers distance ``d``."""
    if metric == "euclidean":
        return d, d
    lat_step = math.degrees(d / G.EARTH_RADIUS) * (1 + 1e-9)
    top = (a.select("y").unionAll(b.select("y")).agg(F.max(F.abs("y"))).first()[0]) or 0.0
    widest = min(abs(top) + lat_step, 90.0)
    shrink = math.cos(math.radians(widest))
    if shrink <= 0:
        return 360.0, lat_step
    half = math.sin(min(d / (2 * G.EARTH_RADIUS), math.pi / 2)) / shrink
    if half >= 1:
        return 360.0, lat_step
    return math.degrees(2 * math.asin(half)) * (1 + 1e-9), lat_step


def _celled(a: DataFrame, b: DataFrame, d: float, metric: str, a_id: str = "id", b_id: str = "id", a_cols=(), b_cols=()) -> tuple[DataFrame, DataFrame]:
    """Both sides with cells cx, cy: a left point in its own one, a right point in all that it can reach."""
    if d <= 0:
        raise ValueError("the distance must be positive")
    sx, sy = _distance_cells(metric, d, a, b)
    columns = max(int(360.0 // sx), 1) if metric == "haversine" else None
    wrap = columns is not None
    if wrap:
        sx = 360.0 / columns   # whole number of columns, each at least as wide as needed

    def col_of(x):
        c = F.floor(x / sx)
        return F.pmod(c, F.lit(columns)) if wrap else c

    left = a.select(F.col(a_id).alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"),
                    col_of(F.col("x")).cast("long").alias("cx"),
                    F.floor(F.col("y") / sy).cast("long").alias("cy"), *[F.col(c).alias("a_" + c) for c in a_cols])
    offsets = [(i, j) for i in ((-1, 0, 1) if not wrap or columns > 2 else range(columns))
               for j in (-1, 0, 1)]
    shifted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                                  for i, j in offsets]))
    right = (b.select(F.col(b_id).alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"),
                      *[F.col(c).alias("b_" + c) for c in b_cols])
             .withColumn("o", shifted))
    nx = F.floor(F.col("bx") / sx) + F.col("o.i")
    right = (right.withColumn("cx", (F.pmod(nx, F.lit(columns)) if wrap else nx).cast("long"))
             .withColumn("cy", (F.floor(F.col("by") / sy) + F.col("o.j")).cast("long"))
             .drop("o"))
    return left, right


def within_distance_join(a: DataFrame, b: DataFrame, d: float, metric: str = "haversine",
                         a_id: str = "id", b_id: str = "id", b_cols=()) -> DataFrame:
    """All pairs of points at most ``d`` apart: ``a_id, b_id, dist`` plus ``b_cols``.

    The result is every such pair, so its size is that of the question asked; skewed cells
    are split by adaptive skew-join handling. With lon/lat input the pairs across the
    antimeridian are found by giving cells the same column modulo 360 degrees.
    """
    left, right = _celled(a, b, d, metric, a_id, b_id, (), b_cols)
    dist = G.distance(metric, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    # the right side is nine times as large as its table, which the planner does not see: it must not be broadcast
    return (left.join(right.hint("merge"), ["cx", "cy"]).withColumn("dist", dist).filter(F.col("dist") <= d)
            .select("a_id", "b_id", "dist", *["b_" + c for c in b_cols]))


def _near_of(a: pa.Table, b: pa.Table, d: float, metric: str, keep: int, by_distance: bool) -> pa.Table:
    """For each left row the number of right rows within ``d`` (in its first row, else 0), and its first ``keep`` of them."""
    names = ["a_id", "n", "dist", "b_id", "b_name"]
    # equal ids keep the order of the rows
    b = b.take(_id_order(b.column("b_id")))
    ax, ay, bx, by = (t.column(c).to_numpy().astype(float) for t, c in ((a, "ax"), (a, "ay"), (b, "bx"), (b, "by")))
    rows, cols, dists, counts = ([np.zeros(0, t)] for t in (np.int64, np.int64, float, np.int64))
    step = max(1, _PAIRS // max(1, len(bx)))
    for at in range(0, len(ax) if len(bx) else 0, step):
        own = _distances(metric, ax[at:at + step, None], ay[at:at + step, None], bx[None], by[None])
        row, col = np.nonzero(own <= d)
        dist = own[row, col]
        if by_distance:
            order = np.lexsort((col, dist, row))
            row, col, dist = row[order], col[order], dist[order]
        first = np.searchsorted(row, row)
        rank, size = np.arange(len(row)) - first, np.searchsorted(row, row, "right") - first
        kept = rank < keep
        rows.append(row[kept] + at)
        cols.append(col[kept])
        dists.append(dist[kept])
        counts.append(np.where(rank == 0, size, 0)[kept])
    rows, cols, dists, counts = (np.concatenate(c) for c in (rows, cols, dists, counts))
    return pa.table([a.column("a_id").take(pa.array(rows)), pa.array(counts, pa.int64()), pa.array(dists, pa.float64()),
                     b.column("b_id").take(pa.array(cols)), b.column("b_name").take(pa.array(cols))], names=names)


def _id_order(ids: pa.ChunkedArray) -> pa.Array:
    """Places in ascending order of ids, null first."""
    at = pa.table({"id": ids, "at": np.arange(len(ids))})
    return pc.sort_indices(at, [("id", "ascending"), ("at", "ascending")], null_placement="at_start")


def near_summary(a: DataFrame, b: DataFrame, d: float, metric: str = "haversine", keep: int = 10, by_distance: bool = True) -> DataFrame:
    """For each left id with a right point within ``d``: id, n (their number) and names, the first ``keep`` by distance and id, or by id."""
    kinds = dict(a.dtypes)["id"], dict(b.dtypes)["id"], dict(b.dtypes)["name"]

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        return _near_of(one, two, d, metric, keep, by_distance)
    found = compare_near(a, b, d, metric, (), ("name",), compare, f"a_id {kinds[0]}, n long, dist double, b_id {kinds[1]}, b_name {kinds[2]}")
    order = ("dist", "b_id") if by_distance else ("b_id",)
    listed = F.slice(F.array_sort(F.collect_list(F.struct(*order, "b_name"))), 1, keep)
    return found.groupBy(F.col("a_id").alias("id")).agg(F.sum("n").alias("n"), F.transform(listed, lambda s: s["b_name"]).alias("names"))


def compare_near(a: DataFrame, b: DataFrame, d: float, metric: str, a_cols, b_cols, compare, schema: str) -> DataFrame:
    """Rows of ``compare(left, right)`` for blocks of points of ``a`` and ``b`` that hold all pairs at most ``d`` apart, each once, and others.

    Tables of a_id, ax, ay, a_* and b_id, bx, by, b_*. Pairs are compared where they arise and never become rows;
    a dense cell is cut into blocks on either side.
    """
    left, right = _celled(a, b, d, metric, a_cols=a_cols, b_cols=b_cols)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cx", "cy").agg(F.ceil(F.count("*") / NEAR_BLOCK).cast("long").alias(name))
    # a row goes to one block of its own side, against every block of the other
    sizes = blocks(left, "an").join(blocks(right, "bn"), ["cx", "cy"])

    def dealt(df: DataFrame, side: str, own: str, other: str, one: str, two: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(side + "_id", side + "x", side + "y"), F.col(own))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return df.join(sizes, ["cx", "cy"]).withColumn(one, mine).withColumn(two, every).drop("an", "bn")

    left, right = dealt(left, "a", "an", "bn", "ka", "kb"), dealt(right, "b", "bn", "an", "kb", "ka")
    key = ["cx", "cy", "ka", "kb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, schema)


def distance_matrix(points: DataFrame, landmarks: DataFrame, method: str = "euclidean",
                    radius: float = 6371.0) -> DataFrame:
    """Dense distances from every point to every landmark, long form.

    The matrix of a layer is ``distance_matrix(layer, layer)``, which is quadratic by definition; points meet
    landmarks in blocks, so no task holds more of it than a row. ``within_distance_join`` gives near pairs only.
    """
    marks = landmarks.select(F.col("id").alias("j"), F.col("x").cast("double").alias("jx"),
                             F.col("y").cast("double").alias("jy"))
    n = marks.count()
    block = F.pmod(F.xxhash64("j", "jx", "jy"), F.lit(-(-n // LANDMARKS) or 1))
    packed = marks.groupBy(block.alias("_b")).agg(F.collect_list(F.struct("j", "jx", "jy")).alias("_t")).select("_t")
    packed = F.broadcast(packed) if n <= LISTED else packed
    out = spread(points.select("id", "x", "y"), "id").crossJoin(packed).select(F.col("id").alias("i"), "x", "y", F.explode("_t").alias("t"))
    args = (F.col("x"), F.col("y"), F.col("t.jx"), F.col("t.jy"))
    dist = G.haversine(*args, radius=radius) if method == "haversine" else G.euclidean(*args)
    return out.select("i", F.col("t.j").alias("j"), dist.alias("dist"))


def matrix_mean(matrix: DataFrame) -> DataFrame:
    """Mean of the upper triangle."""
    return matrix.filter(F.col("i") < F.col("j")).agg(F.avg("dist").alias("mean_distance"),
                                                      F.count("*").alias("pairs"))


def _normal_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s,.;#-]+", " ")


def geocode_join(addresses: DataFrame, *gazetteers: DataFrame, address: str = "address") -> DataFrame:
    """Look addresses up in gazetteer tables (name, x, y); the first one that knows wins."""
    out = addresses.withColumn("_key", _normal_key(F.col(address)))
    found = []
    for i, gaz in enumerate(gazetteers):
        slim = gaz.groupBy(_normal_key(F.col("name")).alias("_key")).agg(
            F.min(F.struct("id", "x", "y")).alias(f"_hit{i}"))
        out = out.join(slim, "_key", "left")
        found.append(F.when(F.col(f"_hit{i}").isNotNull(), F.struct(
            F.col(f"_hit{i}.x").alias("x"), F.col(f"_hit{i}.y").alias("y"),
            F.lit(i).alias("provider"))))
    out = out.withColumn("_geo", F.coalesce(*found))
    return (out.withColumns({"x": F.col("_geo.x"), "y": F.col("_geo.y"),
                             "provider": F.col("_geo.provider")})
            .drop("_key", "_geo", *[f"_hit{i}" for i in range(len(gazetteers))]))


def reverse_geocode_join(points: DataFrame, regions: DataFrame, places: DataFrame,
                         radius: float = 1000.0, keep: int = 10) -> DataFrame:
    """Containing region name, number of places within ``radius`` and the nearest ``keep``."""
    region = points_in_polygons(points.select("id", "x", "y"), regions).groupBy(
        F.col("a_id").alias("id")).agg(F.min("b_name").alias("region"))
    near = near_summary(points, places, radius, keep=keep).select("id", F.col("n").alias("n_places"), F.col("names").alias("places"))
    return points.join(region, "id", "left").join(near, "id", "left").fillna(0, subset=["n_places"])


def map_match(track: DataFrame, segments: DataFrame, max_d: float,
              heading_weight: float = 0.0, switch_penalty: float = 0.0) -> DataFrame:
    """Match track points to road segments within ``max_d`` (planar units).

    ``track``: track, id, tm, x, y and optionally heading (degrees clockwise from north);
    ``segments``: seg, px, py, qx, qy. Cost is distance + heading_weight * angle share +
    switch_penalty when the segment differs from the best one of the previous point.
    """
    boxes = segments.withColumns({
        "minx": F.least("px", "qx") - max_d, "maxx": F.greatest("px", "qx") + max_d,
        "miny": F.least("py", "qy") - max_d, "maxy": F.greatest("py", "qy") + max_d})
    pairs = bbox_pairs(point_boxes(track), boxes, a_is_points=True)
    pairs = pairs.withColumn("dist", G.point_segment_distance(
        F.col("a_x"), F.col("a_y"), F.col("b_px"), F.col("b_py"), F.col("b_qx"), F.col("b_qy")))
    pairs = pairs.filter(F.col("dist") <= max_d)
    cost = F.col("dist")
    if heading_weight and "heading" in track.columns:
        bearing = F.degrees(F.atan2(F.col("b_qx") - F.col("b_px"), F.col("b_qy") - F.col("b_py")))
        turn = F.pmod(F.abs(F.col("a_heading") - bearing), F.lit(180.0))
        cost = cost + F.least(turn, F.lit(180.0) - turn) / 90.0 * heading_weight
    keys = ["a_track", "a_id", "a_tm"]
    scored = pairs.select(*keys, "b_seg", "dist", cost.alias("cost"))
    first = scored.groupBy(*keys).agg(F.min(F.struct("cost", "b_seg", "dist")).alias("m"))
    if not switch_penalty:
        return first.select(F.col("a_track").alias("track"), F.col("a_id").alias("id"),
                            F.col("a_tm").alias("tm"), F.col("m.b_seg").alias("seg"),
                            F.col("m.dist").alias("dist"))
    # a long track is split by time; the last match of the previous non-empty stretch is
    # carried over, so one busy track never sits in a single task
    part = F.floor(F.unix_timestamp(F.col("a_tm").cast("timestamp")) / STRETCH_SECONDS)
    parted = first.select(*keys, part.alias("_p"), F.col("m.b_seg").alias("seg"))
    last = parted.groupBy("a_track", "_p").agg(F.max(F.struct("a_tm", "a_id", "seg")).alias("_l"))
    carried = last.select("a_track", "_p", F.lag("_l.seg").over(
        W.partitionBy("a_track").orderBy("_p")).alias("_carry"))
    w = W.partitionBy("a_track", "_p").orderBy("a_tm", "a_id")
    before = (parted.withColumn("_lag", F.lag("seg").over(w)).join(carried, ["a_track", "_p"])
              .select(*keys, F.coalesce("_lag", "_carry").alias("prev")))
    again = (scored.join(before, keys)
             .withColumn("cost", F.col("cost") + F.when(
                 F.col("prev").isNull() | (F.col("prev") == F.col("b_seg")), 0.0)
                 .otherwise(switch_penalty))
             .groupBy(*keys).agg(F.min(F.struct("cost", "b_seg", "dist")).alias("m")))
    return again.select(F.col("a_track").alias("track"), F.col("a_id").alias("id"),
                        F.col("a_tm").alias("tm"), F.col("m.b_seg").alias("seg"),
                        F.col("m.dist").alias("dist"))


def contiguity(polys: DataFrame, kind: str = "queen", key: str = "id", digits: int = 9) -> DataFrame:
    """Neighbour pairs (i, j), both directions: queen shares a vertex, rook an edge.

    Pairs come from an equality join on the shared vertex or edge key.
    """
    if kind not in ("queen", "rook"):
        raise ValueError("kind must be queen or rook")

    def rounded(p):
        return F.struct((F.round(p["x"], digits) + 0.0).alias("x"),
                        (F.round(p["y"], digits) + 0.0).alias("y"))
    if kind == "queen":
        parts = F.transform(G.vertices(F.col("geom")), rounded)
    else:
        parts = F.transform(G.edges(F.col("geom")),
                            lambda e: F.array_sort(F.array(rounded(e["p"]), rounded(e["q"]))))
    keyed = polys.select(F.col(key).alias("i"), F.explode(F.array_distinct(parts)).alias("part"))
    other = keyed.select(F.col("i").alias("j"), "part")
    return keyed.join(other, "part").filter(F.col("i") != F.col("j")).select("i", "j").distinct()


def spatial_lag(df: DataFrame, w: DataFrame, value: str, key: str = "id",
                area: str | None = None) -> DataFrame:
    """Sum, mean and count of neighbour values; ``density`` = mean / own area when given."""
    vals = df.select(F.col(key).alias("j"), F.col(value).alias("_v"))
    lagged = w.join(vals, "j").groupBy("i").agg(
        F.sum("_v").alias("lag_sum"), F.avg("_v").alias("lag_mean"), F.count("_v").alias("n_neighbors"))
    out = df.join(lagged, df[key] == lagged.i, "left").drop("i").fillna(0, subset=["n_neighbors"])
    return out.withColumn("density", F.col("lag_mean") / F.col(area)) if area else out
