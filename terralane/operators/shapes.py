"""Overlay, dissolve and buffers of polygon layers as polygons, for shapes of any form.

A feature is worked on by itself where that is enough and its vertices and those of all that it meets are few: a buffer
always, an overlay with the features of the other layer whose boxes meet its own. Dissolves and all others are cut up: the plane is
cut into square tiles. Each tile builds the arrangement of the edges in it (see
``functions.arrangement``) and hands on the boundary of every wanted region: closed rings, open paths that end on the tile's border, and
stretches of the border itself. Tiles are then joined eight by eight: stretches that two tiles hold in
opposite directions cancel, and paths that meet are linked, so a level only moves what crosses its borders, however long
a boundary is in all. Nothing is approximated but the snapping of points to 2^-30 of the unit.

Polygons have outer rings counter-clockwise and holes clockwise; rings may touch or cross, what
counts is the winding number. Points on straight runs are left out of the results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from terralane.functions import arrangement as A
from terralane.functions import geometry as G
from terralane.operators.joins import BOX, bbox_pairs
from terralane.session import cut, require, spread

#: Tiles are sized for about so many vertices on average, more where features lie in many layers.
VERTICES = 256
#: A feature and all that it meets are worked on by themselves up to so many vertices.
ALONE = 1024
#: Points of features that are worked on by themselves, taken together.
TOGETHER = 8192
#: Edges of one owner that are merged at a time.
MERGED = 128
#: Tiles joined along each side from one level to the next.
FACTOR = 8
RING, PATH, BORDER = range(3)
OVERLAYS = ("intersection", "union", "difference", "identity", "symmetric_difference")
_RINGS = f"a string, b string, ring {G.PATH_TYPE}, area double"
_ITEMS = "a string, b string, kind int, tx long, ty long, points binary"


def _packed(points: np.ndarray) -> bytes:
    return np.ascontiguousarray(points, np.float64).tobytes()


def _points(content: bytes) -> np.ndarray:
    return np.frombuffer(content, np.float64).reshape(-1, 2)


class Grid:
    """Origin, side and number of the tiles that cover some layers; ``more``: vertices that each feature will gain."""

    def __init__(self, layers: DataFrame, tile: float | None, more: int = 0):
        own = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
        box = layers.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy"), F.sum(F.size(G.vertices(F.col("geom"))) + more),
                         F.sum(own[0] * own[1]), F.avg(F.greatest(*own))).first()
        if box[0] is None:
            self.x0, self.y0, self.side, self.tiles = 0.0, 0.0, 1.0, 1
            return
        wide, high = max(box[2] - box[0], 1e-6), max(box[3] - box[1], 1e-6)
        side = tile or math.sqrt(wide * high * VERTICES / max(box[4] or 1, 1))
        if not tile:
            # features in many layers: tiles much smaller than a feature would hold each of them many times over
            deep = max(box[5] / (wide * high), 1.0)
            side = max(side, min(side * math.sqrt(deep), 2 * box[6]))
        # a power of two, so that lines are exact numbers
        side = 2.0 ** round(math.log2(max(side, A.QUANTUM * 1024, max(wide, high) / 2 ** 20)))
        self.x0, self.y0, self.side = math.floor(box[0] / side) * side, math.floor(box[1] / side) * side, side
        self.tiles = int(max((box[2] - self.x0) // side, (box[3] - self.y0) // side)) + 1


def _rings(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The rings of each geometry as point arrays, from the flat children of the nested lists."""
    rings = column.field("rings")
    paths = rings.values
    at = paths.values
    x, y = at.field("x").to_numpy(zero_copy_only=False), at.field("y").to_numpy(zero_copy_only=False)
    points = A.snap(np.stack([x, y], axis=1)) if len(x) else np.zeros((0, 2))
    outer, inner = rings.offsets.to_numpy(), paths.offsets.to_numpy()
    for i in range(len(column)):
        own = range(outer[i], outer[i + 1]) if rings[i].is_valid else ()
        yield [points[inner[k]:inner[k + 1]] for k in own]


def _upright(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The rings of a feature whose signed areas add up to less than 0, turned."""
    return [r[::-1] for r in rings] if sum(A.signed_area(r) for r in rings if len(r) > 2) < 0 else rings


def _same(rings: list[np.ndarray]) -> list[np.ndarray]:
    return rings


def _strips(loop: np.ndarray, of: np.ndarray, axis: int, origin: float, side: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Loops cut to each strip that they reach: points, number of the part, and each part's loop and strip. Loops have points on the lines that they cross."""
    place = (loop[:, axis] - origin) // side
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    size = np.diff(np.append(starts, len(of)))
    first, last = np.minimum.reduceat(place, starts).astype(np.int64), np.maximum.reduceat(place, starts).astype(np.int64)
    count = last - first + 1
    whose = np.repeat(np.arange(len(starts)), count)
    strip = first[whose] + np.arange(len(whose)) - (np.cumsum(count) - count)[whose]
    part = np.repeat(np.arange(len(whose)), size[whose])
    at = starts[whose][part] + np.arange(len(part)) - (np.cumsum(size[whose]) - size[whose])[part]
    value, low = loop[at, axis], origin + strip[part] * side
    keep = (count[whose][part] == 1) | (value >= low) & (value <= origin + (strip[part] + 1) * side)
    at, part = at[keep], part[keep]
    left = np.bincount(part, minlength=len(whose))
    wide = np.zeros(len(whose), bool)
    wide[part[loop[at, axis] > (origin + strip * side)[part]]] = True
    flat = np.ones(len(whose), bool)
    flat[part[loop[at, axis] < (origin + (strip + 1) * side)[part]]] = False
    # a part of no width, on one of the lines
    real = (count[whose] == 1) | (left >= 3) & wide & ~flat
    keep = real[part]
    return loop[at[keep]], (np.cumsum(real) - 1)[part[keep]], of[starts][whose[real]], strip[real]


def _in_tiles(rings: list[np.ndarray], x0: float, y0: float, side: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ring, tx, ty and (x, y, x, y) of every edge of the closed rings in every tile that they reach, closed along the border."""
    loop, of = np.concatenate([r[:-1] for r in rings]), np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
    loop, of = A.cut_loops(loop, of, x0, y0, side)
    loop, of, ring, tx = _strips(loop, of, 0, x0, side)
    loop, of = A.cut_loops(loop, of, x0, y0, side)
    loop, of, part, ty = _strips(loop, of, 1, y0, side)
    ring, tx = ring[part], tx[part]
    return ring[of], tx[of], ty[of], np.hstack([loop, loop[A.around(of)[1]]])


def _dealt(features: DataFrame, grid: Grid, shape) -> DataFrame:
    """(tx, ty, layer, id, edges) from (layer, id, geom): the edges of each feature in each tile that it reaches, closed along the border.

    ``shape`` turns closed rings into as many that count.
    """
    x0, y0, side = grid.x0, grid.y0, grid.side

    def strips(ring: np.ndarray, axis: int, origin: float) -> Iterator[tuple[int, np.ndarray]]:
        first, last = int((ring[:, axis].min() - origin) // side), int((ring[:, axis].max() - origin) // side)
        for k in range(first, last + 1):
            part = ring if first == last else A.clip_ring(ring, axis, origin + k * side, origin + (k + 1) * side)
            if len(part):
                yield k, part

    def large(ring: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        for tx, strip in strips(A.cut_at_lines(ring, x0, y0, side), 0, x0):
            for ty, part in strips(A.cut_at_lines(strip, x0, y0, side), 1, y0):
                yield tx, ty, np.hstack([part[:-1], part[1:]])

    def edges_of(rings: list[np.ndarray], owner: list[int]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """feature, tx, ty, edges, of some features whole."""
        found: dict[tuple[int, int, int], list[np.ndarray]] = {}
        few, whose = [], []
        for ring, i in zip(shape(rings) if rings else [], owner):
            if len(ring) < 4:
                continue
            reach = (np.ptp(ring, axis=0) // side + 2).sum() * len(ring)
            if reach > TOGETHER:
                for tx, ty, part in large(ring):
                    found.setdefault((i, tx, ty), []).append(part)
            else:
                few.append(ring)
                whose.append(i)
        if few:
            ring, tx, ty, edges = _in_tiles(few, x0, y0, side)
            feature = np.array(whose)[ring]
            order = np.lexsort((ty, tx, feature))
            names = np.stack([feature, tx, ty], axis=1)[order]
            new = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for name, part in zip(names[np.append(0, new)].tolist(), np.split(edges[order], new)):
                found.setdefault(tuple(name), []).append(part)
        for name, parts in found.items():
            yield *name, np.concatenate(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layer, key = batch.column("layer").to_pylist(), batch.column("id").to_pylist()
            rings, owner, held = [], [], 0
            for i, own in enumerate(_rings(batch.column("geom"))):
                own = [r for r in _upright(own) if len(r)]
                rings += own
                owner += [i] * len(own)
                held += sum(len(r) for r in own)
                if held > TOGETHER or i == len(key) - 1:
                    rows = [(tx, ty, layer[k], key[k], _packed(e)) for k, tx, ty, e in edges_of(rings, owner)]
                    if rows:
                        yield _batch(rows)
                    rings, owner, held = [], [], 0

    def _batch(rows):
        types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["tx", "ty", "layer", "id", "edges"])

    return features.select("layer", "id", "geom").mapInArrow(run, "tx long, ty long, layer int, id string, edges binary")


def _regions(how: str, left: np.ndarray, right: np.ndarray, layer: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, inside on the left, inside on the right) of each wanted region; -1 for no owner."""
    if how == "dissolve":
        for k in range(len(layer)):
            yield k, -1, left[:, k], right[:, k]
        return
    one, two = np.flatnonzero(layer == 0), np.flatnonzero(layer == 1)
    if how in ("intersection", "union", "identity"):
        number = lambda x: x.astype(np.float32)
        meet = number(left[:, one]).T @ number(left[:, two]) + number(right[:, one]).T @ number(right[:, two])
        for i, j in zip(*np.nonzero(meet)):
            a, b = one[i], two[j]
            yield a, b, left[:, a] & left[:, b], right[:, a] & right[:, b]
    sides = {"difference": (0,), "identity": (0,), "union": (0, 1), "symmetric_difference": (0, 1)}.get(how, ())
    for own, other, first in ((one, two, True), (two, one, False)):
        if (0 if first else 1) not in sides:
            continue
        free_left, free_right = ~left[:, other].any(axis=1), ~right[:, other].any(axis=1)
        for k in own:
            yield (k, -1, left[:, k] & free_left, right[:, k] & free_right) if first else (-1, k, left[:, k] & free_left, right[:, k] & free_right)


def _outlines(edges: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The boundary of what the closed edges (n x 4) of each group wind around, inside on the left; their groups; whether some wind backwards."""
    p, q, of, label, held = A.node(edges[:, :2], edges[:, 2:], np.zeros(len(edges), np.int64), group)
    if not len(p):
        return np.zeros((0, 4)), held, False
    net = np.bincount(of, 1 - 2 * (label % 2), len(p)).astype(np.int64)[:, None]
    left, right = (side[:, 0] for side in A.group_windings(p, q, net, held))
    bound, turned = (left > 0) != (right > 0), (right > 0)[:, None]
    return np.where(turned, np.hstack([q, p]), np.hstack([p, q]))[bound], held[bound], bool(min(left.min(), right.min()) < 0)


def _merged(edges: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Edges that wind around the same as the closed edges of all parts (in order) together: the outline of outlines of a few parts at a time."""
    whole = edges
    while True:
        _, part = np.unique(part, return_inverse=True)
        size = np.bincount(part.ravel())
        if len(size) < 2:
            break
        # two parts at least, so that their number is halved
        number = np.cumsum(size) // MERGED
        chunk = np.minimum(np.unique(number, return_inverse=True)[1].ravel(), np.arange(len(size)) // 2)
        edges, part, backwards = _outlines(edges, chunk[part.ravel()])
        if backwards:       # windings below 0 count against others, so nothing may be left out
            return whole
    return edges


def _bounds(edges: list[np.ndarray], owner: np.ndarray, layer: np.ndarray, how: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, starts, ends) of the boundary of each wanted region, inside on the left."""
    edges, owner = np.concatenate(edges), np.repeat(owner, [len(e) for e in edges])
    p, q, of, label, _ = A.node(edges[:, :2], edges[:, 2:], owner)
    if not len(p):
        return
    net = np.zeros((len(p), len(layer)), np.int64)
    np.add.at(net, (of, label // 2), 1 - 2 * (label % 2))
    left, right = A.windings(p, q, net)
    for a, b, inside, outside in _regions(how, left > 0, right > 0, layer):
        bound = np.flatnonzero(inside != outside)
        if len(bound):
            turned = outside[bound][:, None]
            yield a, b, np.where(turned, q[bound], p[bound]), np.where(turned, p[bound], q[bound])


def _tile_items(pdf: pd.DataFrame, how: str, x0: float, y0: float, side: float) -> pd.DataFrame:
    """Rings, paths and border stretches of all regions in one tile."""
    tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
    box = (x0 + tx * side, y0 + ty * side, x0 + (tx + 1) * side, y0 + (ty + 1) * side)
    parts: dict[tuple[int, str | None], list[np.ndarray]] = {}
    for layer, key, content in zip(pdf["layer"].tolist(), pdf["id"].tolist(), pdf["edges"]):
        parts.setdefault((layer, key), []).append(np.frombuffer(content, np.float64).reshape(-1, 4))
    owners = list(parts)
    name = lambda k: None if k < 0 else owners[k][1]

    def bounds():
        if how == "dissolve":
            for k, own in enumerate(parts.values()):
                own = [_merged(np.concatenate(own), np.repeat(np.arange(len(own)), [len(e) for e in own]))]
                yield from ((k, *rest) for _, *rest in _bounds(own, np.zeros(1, np.int64), np.zeros(1, np.int64), how))
            return
        edges, number, layer = [np.concatenate(e) for e in parts.values()], np.arange(len(parts)), np.array([o[0] for o in owners])
        if how == "difference" and not (layer == 0).any():
            return
        if how == "difference" and (layer == 1).sum() > 1:
            # which one of the other layer takes something away does not matter
            other = [e for e, n in zip(edges, layer) if n == 1]
            other, part, _ = _outlines(np.concatenate(other), np.repeat(np.arange(len(other)), [len(e) for e in other]))
            other = _merged(other, part)
            edges, layer = [e for e, n in zip(edges, layer) if n == 0] + [other], np.append(layer[layer == 0], 1)
            number, own = np.arange(len(edges)), np.append(number[[o[0] == 0 for o in owners]], -1)
            yield from ((int(own[a]), b, *rest) for a, b, *rest in _bounds(edges, number, layer, how))
            return
        yield from _bounds(edges, number, layer, how)

    rows = []
    on = lambda at: np.stack([at[:, 0] == box[0], at[:, 1] == box[1], at[:, 0] == box[2], at[:, 1] == box[3]], axis=1)
    for a, b, start, end in bounds():
        at_start, at_end = on(start), on(end)
        line, stop = (at_start & at_end).any(axis=1), np.stack([at_start.any(axis=1), at_end.any(axis=1)], axis=1)
        rows += [(name(a), name(b), BORDER, _packed(np.stack([s, e]))) for s, e in zip(start[line], end[line])]
        for path in A.paths(start[~line], end[~line], stop[~line]):
            closed = (path[0] == path[-1]).all() and not (path[0, 0] in (box[0], box[2]) or path[0, 1] in (box[1], box[3]))
            rows.append((name(a), name(b), RING if closed else PATH, _packed(path)))
    out = pd.DataFrame(rows, columns=["a", "b", "kind", "points"])
    out["tx"], out["ty"] = tx, ty
    return out[["a", "b", "kind", "tx", "ty", "points"]]


def _cancelled(edges: np.ndarray, box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Axis-parallel edges (n x 4): what is left inside the box when opposite stretches cancel, and those on its border."""
    p, q = edges[:, :2], edges[:, 2:]
    outer = np.zeros(len(edges), bool)
    for axis in (0, 1):
        for bound in (box[axis], box[axis + 2]):
            outer |= (p[:, axis] == bound) & (q[:, axis] == bound)
    left = []
    for axis in (0, 1):
        own = ~outer & (p[:, axis] == q[:, axis])
        for line in np.unique(p[own, axis]):
            here = own & (p[:, axis] == line)
            start, end = p[here, 1 - axis], q[here, 1 - axis]
            at = np.unique(np.concatenate([start, end]))
            step = np.zeros(len(at), np.int64)
            sign = np.where(start < end, 1, -1)
            np.add.at(step, np.searchsorted(at, np.minimum(start, end)), sign)
            np.add.at(step, np.searchsorted(at, np.maximum(start, end)), -sign)
            for k, n in enumerate(np.cumsum(step)[:-1].tolist()):
                ends = (at[k], at[k + 1]) if n > 0 else (at[k + 1], at[k])
                edge = [(line, e) if axis == 0 else (e, line) for e in ends]
                left += [[*edge[0], *edge[1]]] * abs(n)
    return np.array(left).reshape(-1, 4), edges[outer]


def _joined_items(pdf: pd.DataFrame, x0: float, y0: float, side: float) -> pd.DataFrame:
    """The items of one region in one larger tile (of the given side), linked where they meet inside it."""
    tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
    box = (x0 + tx * side, y0 + ty * side, x0 + (tx + 1) * side, y0 + (ty + 1) * side)
    items = [_points(c) for c in pdf.loc[pdf["kind"] == PATH, "points"]]
    border = [_points(c).ravel() for c in pdf.loc[pdf["kind"] == BORDER, "points"]]
    rows = []
    if border:
        left, kept = _cancelled(np.array(border), box)
        rows += [(BORDER, _packed(e.reshape(2, 2))) for e in kept]
        items += [e.reshape(2, 2) for e in left]
    if items:
        first, last = np.array([i[0] for i in items]), np.array([i[-1] for i in items])
        out = np.array([math.atan2(*(i[1] - i[0])[::-1]) for i in items])
        back = np.array([math.atan2(*(i[-2] - i[-1])[::-1]) for i in items])
        _, number = np.unique(np.concatenate([first, last]), axis=0, return_inverse=True)
        number = number.ravel()
        follow = A.match_turns(number[:len(items)], out, number[len(items):], back)
        outer = (last[:, 0] == box[0]) | (last[:, 0] == box[2]) | (last[:, 1] == box[1]) | (last[:, 1] == box[3])
        follow[outer] = -1
        begins = np.ones(len(items), bool)
        begins[follow[follow >= 0]] = False
        done = np.zeros(len(items), bool)
        for start in [*np.flatnonzero(begins).tolist(), *range(len(items))]:
            chain, at = [], start
            while at >= 0 and not done[at]:
                done[at] = True
                chain.append(at)
                at = int(follow[at])
            if chain:
                path = np.concatenate([items[chain[0]], *(items[k][1:] for k in chain[1:])])
                rows.append((RING if follow[chain[-1]] == chain[0] else PATH, _packed(path)))
    out = pd.DataFrame(rows, columns=["kind", "points"])
    out["a"], out["b"], out["tx"], out["ty"] = pdf["a"].iloc[0], pdf["b"].iloc[0], tx, ty
    return out[["a", "b", "kind", "tx", "ty", "points"]]


def _rings_of(features: DataFrame, grid: Grid, how: str, shape=_same) -> DataFrame:
    """(a, b, ring: path, area) of every region; the ids are text."""
    x0, y0, side, tiles = grid.x0, grid.y0, grid.side, grid.tiles
    dealt = _dealt(features, grid, shape)

    def in_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        return _tile_items(pdf, how, x0, y0, grid.side)

    def joined(x: float, y: float, larger: float):
        return lambda pdf: _joined_items(pdf, x, y, larger)

    items = cut(spread(dealt, "tx", "ty").groupBy("tx", "ty").applyInPandas(in_tile, _ITEMS))
    closed = [items.filter(F.col("kind") == RING)]
    while True:
        side, tiles = side * FACTOR, -(-tiles // FACTOR)
        # the last box is larger than all, so that nothing lies on its border
        last = tiles == 1
        origin = (x0 - side, y0 - side, side * 4) if last else (x0, y0, side)
        parent = [F.lit(0).cast("long").alias(c) if last else F.floor(F.col(c) / FACTOR).cast("long").alias(c) for c in ("tx", "ty")]
        opened = items.filter(F.col("kind") != RING).select("a", "b", "kind", *parent, "points")
        items = cut(opened.groupBy("a", "b", "tx", "ty").applyInPandas(joined(*origin), _ITEMS))
        closed.append(items.filter(F.col("kind") == RING))
        if last:
            break

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, kind, content in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "kind", "points"))):
                if kind != RING:
                    raise ValueError(f"the boundary of {a}, {b} does not close")
                ring = A.tidy(_points(content))
                if len(ring):
                    rows.append((a, b, ring))
            if rows:
                yield _ring_batch(rows)

    whole = items.filter(F.col("kind") != RING)      # none, unless something is wrong
    for part in closed:
        whole = whole.unionAll(part)
    return whole.select("a", "b", "kind", "points").mapInArrow(tidied, _RINGS)


def _ring_batch(rows: list[tuple[str | None, str | None, np.ndarray]]) -> pa.RecordBatch:
    a, b, rings = zip(*rows)
    x, y = np.concatenate(rings).T
    at = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (x, y)], ["x", "y"])
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rings])]).astype(np.int32)
    area = pa.array([A.signed_area(r) for r in rings], pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.ListArray.from_arrays(offsets, at), area], ["a", "b", "ring", "area"])


def _bounds_alone(edges: np.ndarray, owner: np.ndarray, group: np.ndarray, how: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, owner or 0, ring) of the regions of owner 0 in each group: with each other owner, and without all (0)."""
    p, q, of, label, held = A.node(edges[:, :2], edges[:, 2:], owner, group)
    if not len(p):
        return
    net = np.zeros((len(p), int(owner.max()) + 1), np.int64)
    np.add.at(net, (of, label // 2), 1 - 2 * (label % 2))
    left, right = (side > 0 for side in A.group_windings(p, q, net, held))
    inside, outside = left & left[:, :1], right & right[:, :1]
    for sides in (inside, outside):
        sides[:, 0] &= ~sides[:, 1:].any(axis=1)
    bound = inside != outside
    if how == "intersection":
        bound[:, 0] = False
    if how == "difference":
        bound[:, 1:] = False
    piece, other = np.nonzero(bound)
    if not len(piece):
        return
    turned = outside[piece, other][:, None]
    region = held[piece] * net.shape[1] + other
    found = list(A.group_paths(np.where(turned, q[piece], p[piece]), np.where(turned, p[piece], q[piece]), np.zeros(len(piece), bool), region))
    for (number, path), ring in zip(found, A.tidied([path for _, path in found])):
        if (path[0] != path[-1]).any():
            raise ValueError("a boundary does not close")
        if len(ring):
            yield *divmod(number, net.shape[1]), ring


def _rings_alone(groups: DataFrame, how: str, shape=_same) -> DataFrame:
    """(a, b, ring: path, area) of the regions of each row a, parts (list of layer, id, geom), worked on by itself.

    ``shape`` turns many closed rings into those that count. Rows are taken together up to about ``TOGETHER`` edges.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, column = batch.column("a").to_pylist(), batch.column("parts")
            at, parts = column.offsets.to_numpy(), column.values
            layer, key, rings = parts.field("layer").to_pylist(), parts.field("id").to_pylist(), list(_rings(parts.field("geom")))
            todo, held, owners = [], 0, []

            def done():
                if not todo:
                    return None
                whole, owner, group = zip(*todo)
                whole = shape(list(whole))
                edges = [np.hstack([r[:-1], r[1:]]) for r in whole]
                size = [len(e) for e in edges]
                found = _bounds_alone(np.concatenate(edges), np.repeat(owner, size), np.repeat(group, size), how)
                rows = [(name[g], owners[g].get(k), ring) for g, k, ring in found]
                return _ring_batch(rows) if rows else None

            for i in range(len(column)):
                numbers = {}
                for k in range(at[i], at[i + 1]):
                    own = 0 if layer[k] == 0 else numbers.setdefault(key[k], len(numbers) + 1)
                    for ring in _upright(rings[k]):
                        if len(ring) >= 4 or len(ring) and shape is not _same:
                            todo.append((ring, own, i))
                            held += len(ring)
                owners.append({k: b for b, k in numbers.items()})
                if held > TOGETHER:
                    if out := done():
                        yield out
                    todo, held = [], 0
            if out := done():
                yield out

    # many small groups may come in few partitions; a repartition by the same key would be left out as done already
    return spread(groups, F.xxhash64("a")).mapInArrow(run, _RINGS)


def _polygons(rings: DataFrame) -> DataFrame:
    """(a, b, geom, area): the rings of each region together, in the order of their least points."""
    both = F.sort_array(F.collect_list(F.struct(F.col("ring")[0].alias("first"), "area", "ring")))
    out = rings.groupBy("a", "b").agg(both.alias("r"))
    outer = F.size(F.filter("r", lambda x: x["area"] > 0))
    kind = F.when(outer > 1, F.lit("MultiPolygon")).otherwise(F.lit("Polygon"))
    geom = F.struct(kind.alias("type"), F.transform("r", lambda x: x["ring"]).alias("rings"))
    return out.select("a", "b", geom.alias("geom"), F.aggregate("r", F.lit(0.0), lambda s, x: s + x["area"]).alias("area"))


def _layer(df: DataFrame, key: str, number: int) -> DataFrame:
    require(df, key, "geom", *BOX)
    return df.select(F.lit(number).alias("layer"), F.col(key).cast("string").alias("id"), "geom", *BOX)


def _size():
    return F.greatest(F.size(G.vertices(F.col("geom"))), F.lit(0)).cast("long")


def _one_sided(one: DataFrame, two: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    """The rings of the regions that lie in layer 0; ``pairs``: a_id, a_n, b_id, b_n of all boxes that meet."""
    met = pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("id"), F.col("b_n").alias("n")).distinct()
    sizes = one.select(F.col("id").alias("a"), _size().alias("n")).unionAll(met.select("a", "n"))
    sizes = cut(sizes.groupBy("a").agg(F.sum("n").alias("n")))
    few, many = (sizes.filter(test).select(F.col("a").alias("_a")) for test in (F.col("n") <= ALONE, F.col("n") > ALONE))

    def only(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
        return df.join(keys, F.col(key).eqNullSafe(F.col("_a")), "left_semi")
    part = F.struct("layer", "id", "geom").alias("part")
    own = only(one, "id", few).select(F.col("id").alias("a"), part)
    links = only(met.select("a", F.col("id").alias("_b")).distinct(), "a", few)
    near = links.join(two, F.col("_b").eqNullSafe(F.col("id"))).select("a", part)
    rings = _rings_alone(own.unionAll(near).groupBy("a").agg(F.collect_list("part").alias("parts")), how)
    if many.isEmpty():
        return rings
    large = only(one, "id", many)
    reached = only(met, "a", many).select(F.col("id").alias("_a")).distinct()
    both = large.unionAll(only(two, "id", reached))
    return rings.unionAll(_rings_of(both, Grid(both, None), how))


def overlay_shapes(a: DataFrame, b: DataFrame, how: str, a_id: str = "id", b_id: str = "id", tile: float | None = None) -> DataFrame:
    """The pieces of an overlay of two polygon layers: a_id, b_id, geom, area.

    intersection: every a with every b that it meets; difference: every a without all of b; identity: both of these;
    symmetric_difference: a without b, and b without a; union: that and the intersection. An id is null where a piece lies in
    one layer only. Pieces without area are left out; a piece of several parts is one MultiPolygon. Ids are unique within a
    layer and not null; attributes are joined back by them. ``tile``: side of the tiles, rounded to a power of two.
    """
    if how not in OVERLAYS:
        raise ValueError(f"how must be one of {list(OVERLAYS)}")
    one, two = _layer(a, a_id, 0), _layer(b, b_id, 1)
    if tile:
        both = one.unionAll(two)
        rings = _rings_of(both, Grid(both, tile), how)
    else:
        slim = [layer.select("id", _size().alias("n"), *BOX) for layer in (one, two)]
        pairs = cut(bbox_pairs(*slim).select("a_id", "a_n", "b_id", "b_n"))
        rings = _one_sided(one, two, pairs, {"union": "identity", "symmetric_difference": "difference"}.get(how, how))
        if how in ("union", "symmetric_difference"):
            swapped = pairs.select(*[F.col(c).alias(("b" if c[0] == "a" else "a") + c[1:]) for c in pairs.columns])
            rest = _one_sided(two.withColumn("layer", F.lit(0)), one.withColumn("layer", F.lit(1)), swapped, "difference")
            rings = rings.unionAll(rest.select("b", "a", "ring", "area"))
    out = _polygons(rings)
    types = dict(a.dtypes)[a_id], dict(b.dtypes)[b_id]
    return out.select(F.col("a").cast(types[0]).alias("a_id"), F.col("b").cast(types[1]).alias("b_id"), "geom", "area")


def dissolve_rings(df: DataFrame, by: str | None = None, tile: float | None = None) -> DataFrame:
    """The merged shape of each value of ``by`` (null is a value; None: of the whole layer), one ring a row: by, ring, area (holes below 0)."""
    group = F.col(by) if by else F.lit("all")
    shapes = df.select(F.lit(0).alias("layer"), group.cast("string").alias("id"), "geom", *BOX)
    rings = _rings_of(shapes, Grid(shapes, tile), "dissolve")
    return rings.select(F.col("a").cast(dict(df.dtypes)[by]).alias(by), "ring", "area") if by else rings.select("ring", "area")


def dissolve_shapes(df: DataFrame, by: str | None = None, key: str = "id", tile: float | None = None) -> DataFrame:
    """One polygon for each value of ``by`` (or for the whole layer): by, features, other attributes, geom, area, perimeter.

    Attributes are those of the feature with the least ``key``. Borders between merged features vanish, holes and islands stay.
    A value without any area has a null geom and area 0.
    """
    require(df, "geom", key, *BOX)
    group = by or "_all"
    base = df.withColumn("_all", F.lit("all"))
    attrs = [c for c in df.columns if c not in ("geom", *BOX, key, by)]
    first = base.groupBy(group).agg(F.count("*").alias("features"), *[F.min_by(c, key).alias(c) for c in attrs])
    shapes = _polygons(dissolve_rings(base, group, tile).select(F.col(group).alias("a"), F.lit(None).alias("b"), "ring", "area"))
    shapes = shapes.select(F.col("a").alias("_a"), "geom", "area", G.path_length(F.col("geom")).alias("perimeter"))
    out = first.join(shapes, F.col(group).eqNullSafe(F.col("_a")), "left").drop("_a").fillna({"area": 0.0, "perimeter": 0.0})
    return out if by else out.drop("_all")


def offset_ring(loop: np.ndarray, d: float, segments: int) -> np.ndarray:
    """The curve of ``offset_rings`` of one loop."""
    return offset_rings([loop], d, segments)[0]


def offset_rings(loops: list[np.ndarray], d: float, segments: int) -> list[np.ndarray]:
    """The closed curve at distance ``d`` to the right of each closed loop (n x 2, first point not repeated); it may cross itself.

    Outer corners are arcs of the ``segments``-gon; at inner corners it passes the vertex, which leaves
    winding numbers above 0 just where something is within the distance.
    """
    step = 2 * math.pi / segments
    of = np.repeat(np.arange(len(loops)), [len(x) for x in loops])
    loop = np.concatenate([np.zeros((0, 2)), *loops])

    def around(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.bincount(of, minlength=len(loops))
        start = (np.cumsum(size) - size)[of]
        local = np.arange(len(of)) - start
        return start + (local - 1) % size[of], start + (local + 1) % size[of]
    moved = (loop != loop[around(of)[0]]).any(axis=1)
    first = np.concatenate([[True], of[1:] != of[:-1]])[:len(of)]
    # a loop without any length is its first point
    still = np.bincount(of, moved, len(loops)) == 0
    moved |= first & still[of]
    loop, of = loop[moved], of[moved]
    size = np.bincount(of, minlength=len(loops))
    before, after = around(of)
    ahead = loop[after] - loop
    length = np.hypot(ahead[:, 0], ahead[:, 1])
    way = ahead / np.where(length > 0, length, 1.0)[:, None]
    normal = np.stack([way[:, 1], -way[:, 0]], axis=1)
    n1, n2 = normal[before], normal
    turn = way[before, 0] * way[:, 1] - way[before, 1] * way[:, 0]
    same = (way[before] * way).sum(axis=1)
    sharp = np.abs(turn) < 1e-12
    inner = (turn < -1e-15) & ~(sharp & (same < 0))
    arc = ~inner & (~sharp | (same < 0))
    start = np.arctan2(n1[:, 1], n1[:, 0])
    end = start + np.where(sharp, math.pi, np.arctan2(turn, same))
    low, high = np.floor(start / step + 1e-9).astype(np.int64) + 1, np.ceil(end / step - 1e-9).astype(np.int64)
    single = (size == 1)[of]
    low, high = np.where(single, 0, low), np.where(single, segments, high)
    corners = np.where(single | arc, np.maximum(high - low, 0), np.where(inner, 1, 0))
    # d * n1, what lies at the corner, d * n2; a single point has its circle only
    count = np.where(single, corners, corners + 2)
    own = np.repeat(np.arange(len(loop)), count)
    place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    angle = (low[own] + place - np.where(single[own], 0, 1)) * step
    shift = np.where(inner[own, None] & ~single[own, None], 0.0, np.stack([np.cos(angle), np.sin(angle)], axis=1))
    shift = np.where(((place == 0) & ~single[own])[:, None], n1[own], shift)
    shift = np.where(((place == count[own] - 1) & ~single[own])[:, None], n2[own], shift)
    curve = loop[own] + d * shift
    cuts = np.cumsum(np.bincount(of[own], minlength=len(loops)))[:-1]
    return [np.concatenate([c, c[:1]]) for c in np.split(curve, cuts)]


def buffer_shapes(df: DataFrame, d: float, key: str = "id", segments: int = 64, dissolve: bool = False, tile: float | None = None) -> DataFrame:
    """Everything within ``d`` of points, lines and polygons, as polygons (planar units, round ends and corners).

    key, geom, area for each feature, or one row (geom, area) with ``dissolve``. Circles are regular polygons of ``segments`` corners.
    A feature is offset outwards as one curve, and what winds around nothing is left out.
    """
    require(df, key, "geom", *BOX)
    if d <= 0:
        raise ValueError("the distance must be above 0")
    if segments < 4:
        raise ValueError("a circle needs at least 4 segments")
    polygon = G.is_polygon(F.col("geom"))
    owner = F.lit("all") if dissolve else F.col(key).cast("string")
    grown = {c: F.col(c) + (d if c.startswith("max") else -d) for c in BOX}
    shapes = df.select(F.lit(0).alias("layer"), owner.alias("id"), F.struct(
        F.col("geom.type").alias("type"), F.when(polygon, F.col("geom.rings")).otherwise(_there_and_back(F.col("geom.rings"))).alias("rings")).alias("geom"),
        *[v.alias(c) for c, v in grown.items()])

    def curves(rings: list[np.ndarray]) -> list[np.ndarray]:
        return [A.snap(r) for r in offset_rings([r[:-1] if len(r) > 1 else r for r in rings], d, segments)]

    if dissolve or tile:
        rings = _rings_of(shapes, Grid(shapes, tile, segments), "dissolve", curves)
    else:
        sized = shapes.withColumn("n", F.sum(_size() + segments).over(W.partitionBy("id")))
        few, many = sized.filter(F.col("n") <= ALONE), sized.filter(F.col("n") > ALONE).drop("n")
        part = F.collect_list(F.struct("layer", "id", "geom")).alias("parts")
        rings = _rings_alone(few.groupBy(F.col("id").alias("a")).agg(part), "dissolve", curves)
        if not many.isEmpty():
            rings = rings.unionAll(_rings_of(many, Grid(many, None, segments), "dissolve", curves))
    out = _polygons(rings)
    return out.select("geom", "area") if dissolve else out.select(F.col("a").cast(dict(df.dtypes)[key]).alias(key), "geom", "area")


def _there_and_back(paths):
    """Open paths as closed loops without area."""
    return F.transform(paths, lambda p: F.concat(p, F.slice(F.reverse(p), F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))))
