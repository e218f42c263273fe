"""Outline of overlapping rings, and polygons grown by a distance: helpers for a shape, or many at a time.

Rings run counter-clockwise around what they hold and clockwise around holes.
A shape is what rings wind around at least once in all, so shapes are united
by putting their rings together.
"""

from __future__ import annotations

import math

import numpy as np

#: Vertices nearer than this are one, in metres.
SNAP = 1e-6
_ASIDE = 4 * SNAP
#: Pairs of edges of one shape that are looked at a time.
HELD = 400_000


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """Rows (ax, ay, bx, by) of all edges, the closing ones too."""
    some = [r for r in rings if len(r) > 1]
    if not some:
        return np.zeros((0, 4))
    starts = np.concatenate(some)
    ends, last = np.empty_like(starts), np.cumsum([len(r) for r in some]) - 1
    ends[:-1] = starts[1:]
    ends[last] = starts[np.append(0, last[:-1] + 1)]
    edges = np.hstack([starts, ends])
    return edges[np.hypot(edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]) > SNAP]


def _padded(values: np.ndarray, starts: np.ndarray, fill: float) -> np.ndarray:
    """A row for each shape, as long as the longest."""
    n = np.diff(starts)
    out = np.full((len(n), n.max(initial=0)), fill)
    out[np.arange(out.shape[1]) < n[:, None]] = values
    return out


def _divided(edges: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges cut where they meet others of their shape, or the ends of others lie on them, and the edge of each piece; only those whose boxes meet are looked at."""
    a, d = edges[:, :2], edges[:, 2:] - edges[:, :2]
    size = np.hypot(d[:, 0], d[:, 1])
    low, high = np.minimum(a, edges[:, 2:]) - _ASIDE, np.maximum(a, edges[:, 2:]) + _ASIDE
    x0, y0 = (_padded(v, starts, np.inf) for v in low.T)
    x1, y1 = (_padded(v, starts, -np.inf) for v in high.T)
    k, i, j = np.nonzero((x0[:, :, None] <= x1[:, None]) & (x1[:, :, None] >= x0[:, None]) & (y0[:, :, None] <= y1[:, None]) & (y1[:, :, None] >= y0[:, None]))
    i, j = starts[k] + i, starts[k] + j
    (dx, dy), (ex, ey), long, other = d[i].T, d[j].T, size[i], size[j]
    (ax, ay), (bx, by) = a[j].T - a[i].T, edges[j, 2:].T - a[i].T
    cross = dx * ey - dy * ex
    apart = np.abs(cross) > 1e-12 * long * other
    safe = np.where(apart, cross, 1.0)
    t, u = (ax * ey - ay * ex) / safe, (ax * dy - ay * dx) / safe
    meets = apart & (t > -SNAP / long) & (t < 1 + SNAP / long) & (u > -SNAP / other) & (u < 1 + SNAP / other)
    owners, places = [i[meets]], [t[meets]]
    for px, py in ((ax, ay), (bx, by)):
        along = (px * dx + py * dy) / (long * long)
        on = (np.abs(px * dy - py * dx) / long < SNAP) & (along > 0) & (along < 1)
        owners.append(i[on])
        places.append(along[on])
    every = np.arange(len(a))
    owner, t = np.concatenate([*owners, every, every]), np.concatenate([*places, np.zeros(len(a)), np.ones(len(a))])
    t = np.clip(t, 0, 1)
    order = np.lexsort((t, owner))
    owner, t = owner[order], t[order]
    points = np.round((a[owner] + t[:, None] * d[owner]) / SNAP) * SNAP
    same = owner[1:] == owner[:-1]
    pieces = np.hstack([points[:-1][same], points[1:][same]])
    kept = (pieces[:, :2] != pieces[:, 2:]).any(1)
    return pieces[kept], owner[:-1][same][kept]


def winding(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How often rings wind around each point."""
    return _windings(points, np.array([0, len(points)]), edges, np.array([0, len(edges)]))


def _windings(points: np.ndarray, point_starts: np.ndarray, edges: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``winding`` of each shape's points; sides are told only of edges that cross a point's row."""
    y = _padded(points[:, 1], point_starts, np.inf)[:, :, None]
    below, above = _padded(edges[:, 1], starts, np.inf)[:, None] <= y, _padded(edges[:, 3], starts, np.inf)[:, None] > y
    k, p, e = np.nonzero(below == above)
    up = below[k, p, e]
    p, e = point_starts[k] + p, starts[k] + e
    (x, y), (ax, ay, bx, by) = points[p].T, edges[e].T
    left = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
    turn = np.where(up, left > 0, 0) - np.where(~up, left < 0, 0)
    return np.bincount(p, turn, len(points)).astype(int)


def outline(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Rings around what the given rings wind around, without overlaps; holes run clockwise."""
    return outlines([rings])[0]


def outlines(shapes: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """``outline`` of each shape, of shapes of about the same number of edges many at a time."""
    edges = [_edges(rings) for rings in shapes]
    out: list[list[np.ndarray]] = [[] for _ in shapes]
    some: list[int] = []
    for k in sorted((k for k, e in enumerate(edges) if len(e)), key=lambda k: len(edges[k])):
        if some and (len(some) + 1) * len(edges[k]) ** 2 > HELD:
            _outlined(edges, some, out)
            some = []
        some.append(k)
    if some:
        _outlined(edges, some, out)
    return out


def _outlined(of_shapes: list[np.ndarray], some: list[int], out: list[list[np.ndarray]]) -> None:
    edges, starts = np.concatenate([of_shapes[k] for k in some]), np.append(0, np.cumsum([len(of_shapes[k]) for k in some]))
    pieces, owner = _divided(edges, starts)
    shape = np.searchsorted(starts, owner, "right") - 1
    swap = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    pieces[swap] = pieces[swap][:, [2, 3, 0, 1]]
    order = np.lexsort((*pieces.T[::-1], shape))
    pieces, shape = pieces[order], shape[order]
    first = np.append(True, (pieces[1:] != pieces[:-1]).any(1) | (shape[1:] != shape[:-1]))[: len(pieces)]
    pieces, shape = pieces[first], shape[first]
    d = pieces[:, 2:] - pieces[:, :2]
    normal = np.stack([-d[:, 1], d[:, 0]], 1) / np.hypot(d[:, 0], d[:, 1])[:, None] * _ASIDE
    middle = (pieces[:, :2] + pieces[:, 2:]) / 2
    at = np.searchsorted(shape, np.arange(len(some) + 1))
    left, right = (_windings(middle + side, at, edges, starts) > 0 for side in (normal, -normal))
    pieces, shape = np.vstack([pieces[left & ~right], pieces[right & ~left][:, [2, 3, 0, 1]]]), np.append(shape[left & ~right], shape[right & ~left])
    order = np.argsort(shape, kind="stable")
    pieces, at = pieces[order], np.searchsorted(shape[order], np.arange(len(some) + 1))
    for i, k in enumerate(some):
        out[k] = _stitched(pieces[at[i] : at[i + 1]])


def _stitched(pieces: np.ndarray) -> list[np.ndarray]:
    """Edges put one after the other; where several leave a vertex, the one furthest to the left goes on."""
    rows = pieces.tolist()
    leaving: dict[tuple, list[int]] = {}
    for i, (x, y, _, _) in enumerate(rows):
        leaving.setdefault((x, y), []).append(i)
    used, out = [False] * len(rows), []
    for first in range(len(rows)):
        if used[first]:
            continue
        i, ring, start = first, [], (rows[first][0], rows[first][1])
        while True:
            used[i] = True
            ax, ay, bx, by = rows[i]
            ring.append((ax, ay))
            if (bx, by) == start:
                out.append(_straight(np.array(ring)))
                break
            ways = [j for j in leaving.get((bx, by), ()) if not used[j]]
            if not ways:
                break
            i = ways[0]
            if len(ways) > 1:
                back = math.atan2(ay - by, ax - bx)
                i = min(ways, key=lambda j: (back - math.atan2(rows[j][3] - by, rows[j][2] - bx)) % (2 * math.pi))
    return [r for r in out if len(r) > 2]


def _straight(ring: np.ndarray) -> np.ndarray:
    """A ring without vertices on straight lines."""
    d = np.diff(ring, axis=0, prepend=ring[-1:])
    a, b = d, np.concatenate([d[1:], d[:1]])
    long = np.hypot(a[:, 0], a[:, 1])
    bend = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > SNAP * np.maximum(long, np.concatenate([long[1:], long[:1]]))
    return ring[bend]


def signed_area(ring: np.ndarray) -> float:
    x, y = ring.T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def turned(rings: list[np.ndarray]) -> list[np.ndarray]:
    """A polygon's rings: the first counter-clockwise, the others clockwise."""
    return [r if (signed_area(r) > 0) == (i == 0) else r[::-1] for i, r in enumerate(rings) if len(r) > 2]


def margin(rings: list[np.ndarray], distance: float, segments: int = 8) -> list[np.ndarray]:
    """Rings of what lies within ``distance`` outside a polygon: a strip along each edge, and at each outer corner a sector of an arc in ``segments`` a quarter."""
    out = []
    for ring in rings:
        edges = _edges([ring])
        d = edges[:, 2:] - edges[:, :2]
        out_of = np.stack([d[:, 1], -d[:, 0]], 1) / np.hypot(d[:, 0], d[:, 1])[:, None]
        for (ax, ay, bx, by), (nx, ny) in zip(edges, out_of * distance):
            out.append(np.array([(bx, by), (ax, ay), (ax + nx, ay + ny), (bx + nx, by + ny)]))
        for i in range(len(edges)):
            j = (i + 1) % len(edges)
            first = math.atan2(out_of[i, 1], out_of[i, 0])
            sweep = (math.atan2(out_of[j, 1], out_of[j, 0]) - first) % (2 * math.pi)
            if 1e-9 < sweep < math.pi + 1e-9:
                step = math.pi / 2 / segments
                turns = np.append(first + step * np.arange(math.ceil(sweep / step - 1e-9)), first + sweep)
                out.append(np.vstack([edges[j, :2], edges[j, :2] + distance * np.stack([np.cos(turns), np.sin(turns)], 1)]))
    return out


def grown(polygons: list[list[np.ndarray]], distance: float, segments: int = 8) -> list[list[np.ndarray]]:
    """Outlines of polygons grown by ``distance``."""
    own = [turned(rings) for rings in polygons]
    return outlines([[*rings, *margin(rings, distance, segments)] for rings in own])


def moved_unions(shapes: list[list[np.ndarray]], shifts: list[tuple[float, float]]) -> list[list[np.ndarray]]:
    """Outlines, each united with its copy moved by its shift."""
    moved = outlines([rings if shift == (0.0, 0.0) else [*rings, *[r + np.array(shift) for r in rings]] for rings, shift in zip(shapes, shifts)])
    return [rings if shift == (0.0, 0.0) else union for rings, shift, union in zip(shapes, shifts, moved)]


def grown_union(rings: list[np.ndarray], shift: tuple[float, float], distance: float, segments: int = 8) -> list[np.ndarray]:
    """A polygon united with its copy moved by ``shift``, grown by ``distance``.

    What is grown is the union of the polygon and its copy, which is the union
    of both grown; so the polygon is grown first, by itself.
    """
    if not rings or not len(rings[0]):
        return []
    origin = rings[0][0]
    return [r + origin for r in moved_unions(grown([[r - origin for r in rings]], distance, segments), [shift])[0]]
