"""Planar arrangements of labelled rings, within one tile.

Edges are cut at every meeting point, equal pieces are summed up by their direction, and each owner's winding
number left and right of every piece follows from the pieces below it. Which pieces bound a wanted region is then a
comparison of two truth values; regions come out as paths with their inside on the left.

Many small arrangements are made at once where edges come with the number of their group: only edges of one group meet.

Coordinates are snapped to multiples of ``QUANTUM`` (a power of two), so that equal points have equal numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

QUANTUM = 2.0 ** -30
#: Rows of the comparison of all pieces with all pieces that are held at once, in pairs.
_PAIRS = 1 << 21


def snap(values: np.ndarray) -> np.ndarray:
    return np.rint(values / QUANTUM) * QUANTUM + 0.0


def around(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the point before and after each point of loops; ``of``: the number of each point's loop, ascending."""
    size = np.bincount(of)
    start = (np.cumsum(size) - size)[of]
    local = np.arange(len(of)) - start
    return start + (local - 1) % size[of], start + (local + 1) % size[of]


def cut_at_lines(ring: np.ndarray, x0: float, y0: float, tile: float) -> np.ndarray:
    """A closed ring with a point wherever it crosses a line of the grid."""
    loop, _ = cut_loops(ring[:-1], np.zeros(len(ring) - 1, np.int64), x0, y0, tile)
    return np.concatenate([loop, loop[:1]])


def cut_loops(loop: np.ndarray, of: np.ndarray, x0: float, y0: float, tile: float) -> tuple[np.ndarray, np.ndarray]:
    """Loops (``of``: the number of each point's loop, ascending) with a point wherever they cross a line of the grid.

    It is computed on the edge from its left end, so every tile gets the same.
    """
    p, q = loop, loop[around(of)[1]]
    swap = (p[:, 0] > q[:, 0]) | (p[:, 0] == q[:, 0]) & (p[:, 1] > q[:, 1])
    low, high = np.where(swap[:, None], q, p), np.where(swap[:, None], p, q)
    edge, at, point = [], [], []
    for axis, origin in ((0, x0), (1, y0)):
        near, far = np.minimum(low[:, axis], high[:, axis]), np.maximum(low[:, axis], high[:, axis])
        first, last = np.floor((near - origin) / tile).astype(np.int64) + 1, np.ceil((far - origin) / tile).astype(np.int64) - 1
        count = np.maximum(last - first + 1, 0)
        own = np.repeat(np.arange(len(p)), count)
        if not len(own):
            continue
        line = origin + tile * (np.repeat(first, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count))
        t = (line - low[own, axis]) / (high[own, axis] - low[own, axis])
        met = snap(low[own] + t[:, None] * (high[own] - low[own]))
        met[:, axis] = line
        edge.append(own)
        at.append(np.where(swap[own], 1 - t, t))
        point.append(met)
    if not edge:
        return loop, of
    edge, at, point = np.concatenate([np.arange(len(p)), *edge]), np.concatenate([np.zeros(len(p)), *at]), np.concatenate([p, *point])
    order = np.lexsort((at, edge))
    out, of = point[order], of[edge[order]]
    keep = np.concatenate([[True], (out[1:] != out[:-1]).any(axis=1) | (of[1:] != of[:-1])])
    return out[keep], of[keep]


def clip_ring(ring: np.ndarray, axis: int, low: float, high: float) -> np.ndarray:
    """A closed ring that has points on both lines wherever it crosses them, cut to the strip between; winding numbers inside stay."""
    for bound, sign in ((low, 1.0), (high, -1.0)):
        keep = sign * (ring[:, axis] - bound) >= 0
        if not keep.all():
            ring = ring[:-1][keep[:-1]]
            ring = np.concatenate([ring, ring[:1]]) if len(ring) else ring
    return ring if len(ring) >= 4 and np.ptp(ring[:, axis]) > 0 else ring[:0]


def _ranked(group: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers in the order of groups and, within one, of the values (several arrays on one scale)."""
    scale, rank = np.unique(np.concatenate(values), return_inverse=True)
    return [group * len(scale) + r for r in np.split(rank.ravel(), np.cumsum([len(v) for v in values])[:-1])]


def _spans(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, first[i]), (i, first[i] + 1) ... of every i, about _PAIRS at a time."""
    at, total = 0, np.cumsum(count)
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
        own = np.repeat(np.arange(at, stop), count[at:stop])
        if len(own):
            yield own, first[own] + np.arange(len(own)) - np.repeat(np.cumsum(count[at:stop]) - count[at:stop], count[at:stop])
        at = stop


def _candidates(low: np.ndarray, high: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j in the order of their left ends) of boxes of one group that meet, some at a time."""
    start, end = _ranked(group, low[:, 0], high[:, 0])
    order = np.argsort(start, kind="stable")
    last = np.searchsorted(start[order], end[order], "right")
    for own, other in _spans(np.arange(len(order)) + 1, last - np.arange(len(order)) - 1):
        i, j = order[own], order[other]
        meet = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        yield i[meet], j[meet]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in ascending order, and the place of each row among them."""
    order = np.lexsort(rows.T[::-1])
    new = np.concatenate([[True], (rows[order[1:]] != rows[order[:-1]]).any(axis=1)])[:len(rows)]
    of = np.empty(len(rows), np.int64)
    of[order] = np.cumsum(new) - 1
    return rows[order[new]], of


def _cuts(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of edges and the points that they have to be cut at: crossings, and ends of one edge on another."""
    low, high = np.minimum(a, b) - QUANTUM, np.maximum(a, b) + QUANTUM
    edge, point = [np.zeros(0, np.int64)], [np.zeros((0, 2))]
    for i, j in _candidates(low, high, group):
        r, s, c = b[i] - a[i], b[j] - a[j], a[j] - a[i]
        d = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
        some = np.where(d == 0, 1.0, d)
        t = (c[:, 0] * s[:, 1] - c[:, 1] * s[:, 0]) / some
        u = (c[:, 0] * r[:, 1] - c[:, 1] * r[:, 0]) / some
        hit = np.flatnonzero((d != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1))
        met = snap(a[i[hit]] + t[hit, None] * r[hit])
        edge += [i[hit], j[hit]]
        point += [met, met]
        for x, y in ((i, j), (j, i)):            # ends of y that lie on x
            length = np.hypot(*(b[x] - a[x]).T)
            direction = (b[x] - a[x]) / length[:, None]
            for end in (a[y], b[y]):
                off = end - a[x]
                along = (off * direction).sum(axis=1)
                aside = np.abs(direction[:, 0] * off[:, 1] - direction[:, 1] * off[:, 0])
                on = np.flatnonzero((aside <= QUANTUM) & (along > 0) & (along < length))
                edge.append(x[on])
                point.append(end[on])
    edge, point = np.concatenate(edge), np.concatenate(point)
    real = (point != a[edge]).any(axis=1) & (point != b[edge]).any(axis=1)
    return edge[real], point[real]


def node(a: np.ndarray, b: np.ndarray, owner: np.ndarray, group: np.ndarray | None = None):
    """Distinct pieces (ends p < q, left end first) that meet at ends only; (piece, owner * 2 + backward) for every edge through them; each piece's group."""
    group = np.zeros(len(a), np.int64) if group is None else group
    while True:
        real = (a != b).any(axis=1)
        a, b, owner, group = a[real], b[real], owner[real], group[real]
        if not len(a):
            return a, b, *[np.zeros(0, np.int64)] * 3
        back = (a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])
        ends = np.where(back[:, None], np.hstack([b, a]), np.hstack([a, b]))
        pieces, of = _distinct(np.column_stack([group, ends]))
        held, p, q = pieces[:, 0].astype(np.int64), pieces[:, 1:3], pieces[:, 3:]
        edge, point = _cuts(p, q, held)
        label = owner * 2 + back
        if not len(edge):
            return p, q, of, label, held
        along = ((point - p[edge]) * (q[edge] - p[edge])).sum(axis=1)
        order = np.lexsort((along, edge))
        edge, point = edge[order], point[order]
        # chains p, cut points, q of every piece
        whole = np.concatenate([np.arange(len(p)), edge, np.arange(len(p))])
        rank = np.concatenate([np.full(len(p), -1), np.arange(len(edge)), np.full(len(p), len(edge))])
        points = np.concatenate([p, point, q])
        order = np.lexsort((rank, whole))
        whole, points = whole[order], points[order]
        inside = whole[1:] == whole[:-1]
        start, end, piece = points[:-1][inside], points[1:][inside], whole[:-1][inside]
        # every edge goes through the parts of its piece, in its direction
        count = np.bincount(piece, minlength=len(p))
        first = np.cumsum(count) - count
        size = count[of]
        part = np.repeat(first[of] - np.cumsum(size) + size, size) + np.arange(size.sum())
        turned = np.repeat(back, size)[:, None]
        a, b = np.where(turned, end[part], start[part]), np.where(turned, start[part], end[part])
        owner, group = np.repeat(owner, size), np.repeat(group, size)


def windings(p: np.ndarray, q: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winding numbers (pieces x owners) left and right of each piece from p to q; ``net``: forward less backward edges."""
    steep = p[:, 0] == q[:, 0]
    mx, my = (p[:, 0] + q[:, 0]) / 2, (p[:, 1] + q[:, 1]) / 2
    slope = np.where(steep, 0.0, (q[:, 1] - p[:, 1]) / np.where(steep, 1.0, q[:, 0] - p[:, 0]))
    flat = np.flatnonzero(~steep)
    fp, fq, fs, fnet = p[flat], q[flat], slope[flat], net[flat].astype(np.float64)
    below = np.zeros(net.shape)
    step = max(1, _PAIRS // max(1, len(flat)))
    for at in range(0, len(p), step):
        part = slice(at, at + step)
        x, y = mx[part, None], my[part, None]
        # a steep piece looks down just left of itself, any other from its middle
        cover = np.where(steep[part, None], (fp[None, :, 0] < x) & (x <= fq[None, :, 0]), (fp[None, :, 0] <= x) & (x < fq[None, :, 0]))
        under = fp[None, :, 1] + fs[None] * (x - fp[None, :, 0]) < y
        under &= flat[None] != np.arange(at, min(at + step, len(p)))[:, None]
        below[part] = (cover & under).astype(np.float64) @ fnet
    below = np.rint(below).astype(np.int64)
    left = np.where(steep[:, None], below, below + net)
    return left, left - net


def group_windings(p: np.ndarray, q: np.ndarray, net: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``windings``, for many small groups; an owner's number counts within its group."""
    steep = p[:, 0] == q[:, 0]
    mx, my = (p[:, 0] + q[:, 0]) / 2, (p[:, 1] + q[:, 1]) / 2
    flat = np.flatnonzero(~steep)
    ranks, = _ranked(np.concatenate([group, group[flat]]), np.concatenate([mx, p[flat, 0]]))
    middle, start = ranks[:len(p)], ranks[len(p):]
    flat = flat[np.argsort(start, kind="stable")]
    start = np.sort(start)
    first = np.searchsorted(group[flat], group, "left")
    slope = np.where(steep, 0.0, (q[:, 1] - p[:, 1]) / np.where(steep, 1.0, q[:, 0] - p[:, 0]))
    # those of its group that begin left of its middle (a steep piece looks down just left of itself)
    count = np.searchsorted(start, middle, "right") - first
    row, column = np.nonzero(net)
    value, size = net[row, column], np.bincount(row, minlength=len(p))
    at = np.cumsum(size) - size
    below = np.zeros(net.size)
    for i, k in _spans(first, count):
        j = flat[k]
        x = mx[i]
        cover = np.where(steep[i], (p[j, 0] < x) & (x <= q[j, 0]), x < q[j, 0])
        hit = cover & (p[j, 1] + slope[j] * (x - p[j, 0]) < my[i]) & (i != j)
        i, j = i[hit], j[hit]
        entry = np.repeat(at[j] - np.cumsum(size[j]) + size[j], size[j]) + np.arange(size[j].sum())
        below += np.bincount(np.repeat(i, size[j]) * net.shape[1] + column[entry], value[entry], net.size)
    below = np.rint(below).astype(np.int64).reshape(net.shape)
    left = np.where(steep[:, None], below, below + net)
    return left, left - net


def paths(p: np.ndarray, q: np.ndarray, stop: np.ndarray) -> Iterator[np.ndarray]:
    """Directed edges joined to paths (point arrays); a path ends where it closes or at a point of ``stop`` (for each edge's q, and p).

    Where several edges leave a point, the path keeps to the face on its left: it takes the first one clockwise from where it came.
    """
    for _, path in group_paths(p, q, stop[:, 1], np.zeros(len(p), np.int64)):
        yield path


def group_paths(p: np.ndarray, q: np.ndarray, stop: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, path) of all paths; edges of different groups do not meet."""
    n = len(p)
    if not n:
        return
    points, number = _distinct(np.column_stack([np.concatenate([group, group]), np.concatenate([p, q])]))
    points = points[:, 1:]
    tail, head = number[:n], number[n:]
    follow = _followers(p, q, tail, head)
    follow[stop] = -1
    begins = np.ones(n, bool)
    begins[follow[follow >= 0]] = False
    done = np.zeros(n, bool).tolist()
    follow_list = follow.tolist()
    for first in [*np.flatnonzero(begins).tolist(), *range(n)]:
        if done[first]:
            continue
        chain, at = [], first
        while at >= 0 and not done[at]:
            done[at] = True
            chain.append(at)
            at = follow_list[at]
        yield int(group[first]), points[np.append(tail[chain], head[chain[-1]])]


def _followers(p: np.ndarray, q: np.ndarray, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each edge the edge after it (-1: none)."""
    out = np.arctan2(q[:, 1] - p[:, 1], q[:, 0] - p[:, 0])
    back = np.arctan2(p[:, 1] - q[:, 1], p[:, 0] - q[:, 0])
    return match_turns(tail, out, head, back)


def match_turns(tail: np.ndarray, out: np.ndarray, head: np.ndarray, back: np.ndarray) -> np.ndarray:
    """For each arrival at a point (``head``, looking ``back``) the departure (``tail``, ``out``) first clockwise from it; -1 where there is none.

    At a point departures and arrivals alternate around it, so each departure is taken once.
    """
    n = len(tail)
    order = np.lexsort((out, tail))
    start = np.searchsorted(tail[order], head, "left")
    end = np.searchsorted(tail[order], head, "right")
    follow = np.full(n, -1, np.int64)
    single = end - start == 1
    follow[single] = order[start[single]]
    for i in np.flatnonzero(end - start > 1).tolist():
        own = order[start[i]:end[i]]
        turn = np.mod(back[i] - out[own], 2 * np.pi)
        turn[turn <= 1e-12] += 2 * np.pi         # straight back comes last
        follow[i] = own[np.argmin(turn)]
    return follow


def tidy(ring: np.ndarray) -> np.ndarray:
    """A closed ring without points on straight runs; empty when hardly any area is left."""
    return tidied([ring])[0]


def tidied(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Each closed ring without points on straight runs, from its least point; empty when hardly any area is left."""
    loop, of = np.concatenate([r[:-1] for r in rings]), np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
    while True:
        size = np.bincount(of, minlength=len(rings))
        start = np.cumsum(size) - size
        local = np.arange(len(loop)) - start[of]
        before, after = start[of] + (local - 1) % size[of], start[of] + (local + 1) % size[of]
        d = loop[after] - loop[before]
        length = np.hypot(d[:, 0], d[:, 1])
        off = loop - loop[before]
        aside = np.abs(d[:, 0] * off[:, 1] - d[:, 1] * off[:, 0]) <= 2 * QUANTUM * np.maximum(length, QUANTUM)
        # not two neighbours at once: each is judged by points that stay
        drop = np.where((np.bincount(of, aside, len(rings)) == size)[of], local % 2 == 1, aside & ~aside[before])
        drop &= size[of] >= 3
        if not drop.any():
            break
        loop, of = loop[~drop], of[~drop]
    step = loop[after] - loop
    away = loop - loop[start[of]]
    area = np.bincount(of, away[:, 0] * step[:, 1] - away[:, 1] * step[:, 0], len(rings)) / 2
    real = (size >= 3) & (np.abs(area) > 2 * QUANTUM * np.bincount(of, np.hypot(step[:, 0], step[:, 1]), len(rings)))
    order = np.lexsort((loop[:, 1], loop[:, 0], of))
    out = []
    for k, (at, n, good) in enumerate(zip(start.tolist(), size.tolist(), real.tolist())):
        least = order[at] - at if good else 0
        own = loop[at:at + n]
        out.append(np.concatenate([own[least:], own[:least + 1]]) if good else rings[k][:0])
    return out


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)
