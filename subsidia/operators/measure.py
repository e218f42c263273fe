"""Points measured against polygons, many pairs at a time.

Expressions over arrays of vertices are interpreted, some microseconds for
each edge.  Here pairs are handed to Arrow, and the edges of many pairs are one
array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Edges that are measured at a time.
EDGES = 500_000
#: A point so near an edge is on it.
BORDER = 1e-9


def flat_rings(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Polygons as flat arrays: where each one's rings start, where each ring's vertices start, both with their end, and x and y."""
    of_ring = rings.flatten()
    count = lambda a: np.append(0, np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
    x, y = (c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in of_ring.flatten().flatten())
    return count(rings), count(of_ring), x, y


def distances(x: np.ndarray, y: np.ndarray, rings: pa.Array, scale: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Distance of each place to its polygon, 0 where that covers it (even-odd, border included); NaN without a place or an edge.

    ``scale`` has the metres of a unit of x and y at each place.
    """
    ring_of, vertex_of, vx, vy = flat_rings(rings)
    starts, out = vertex_of[ring_of], np.full(len(x), np.nan)
    # The end of an edge is the next vertex, or the first of its ring.
    after = np.arange(1, len(vx) + 1)
    some = np.diff(vertex_of) > 0
    after[vertex_of[1:][some] - 1] = vertex_of[:-1][some]
    at = 0
    while at < len(x):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + EDGES, "right")) - 1)
        out[at:end] = _measured(x[at:end], y[at:end], starts[at : end + 1], vx, vy, after, scale and (scale[0][at:end], scale[1][at:end]))
        at = end
    return out


def _measured(x, y, starts, vx, vy, after, scale) -> np.ndarray:
    n = np.diff(starts)
    out, known = np.full(len(x), np.nan), n > 0
    if not known.any():
        return out
    own, to = slice(starts[0], starts[-1]), after[starts[0] : starts[-1]]
    each = lambda v: np.repeat(v, n)
    x, y = each(x), each(y)
    ax, ay, dx, dy = vx[own], vy[own], vx[to] - vx[own], vy[to] - vy[own]
    px, py = x - ax, y - ay
    above, below = ay > y, vy[to] > y
    if scale is not None:
        kx, ky = each(scale[0]), each(scale[1])
        px, py, dx, dy = px * kx, py * ky, dx * kx, dy * ky
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = (above != below) & (px < dx * py / dy if scale is not None else x < dx * py / dy + ax)
        length = dx * dx + dy * dy
        t = np.where(length > 0, np.clip((px * dx + py * dy) / length, 0.0, 1.0), 0.0)
        off_x, off_y = px - t * dx, py - t * dy
        away = np.sqrt(off_x * off_x + off_y * off_y)
    firsts = (starts[:-1] - starts[0])[known]
    edge = np.fmin.reduceat(away, firsts)
    odd = np.add.reduceat(crosses.astype(np.int64), firsts) % 2 == 1
    out[known] = np.where(np.isnan(edge), np.nan, np.where(odd | (edge <= BORDER), 0.0, edge))
    return out


def with_distances(pairs: DataFrame, places: dict[str, tuple[str, ...]], rings: str = "rings") -> DataFrame:
    """``pairs`` without their ``rings``, and with the distances to them under the names of ``places``.

    A place is the names of its columns x and y, and where metres are not the
    rings' unit those of the metres of a unit of x and y; place columns go too.
    No place, no edge: null.
    """
    gone = {rings, *[c for columns in places.values() for c in columns]}
    kept = [c for c in pairs.columns if c not in gone]
    kinds = dict(pairs.dtypes)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: batch[c].cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in gone - {rings}}
            found = []
            for columns in places.values():
                x, y, *scale = (values[c] for c in columns)
                found.append(pa.array(distances(x, y, batch[rings], tuple(scale) or None), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *found], [*kept, *places])

    return pairs.mapInArrow(measured, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], *[f"`{c}` double" for c in places]]))
