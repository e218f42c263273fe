"""Candidate areas: where the radar points of a building can lie in the view of a track."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsidia.functions import overlay
from subsidia.functions.geo import range_offset
from subsidia.operators.assign import CELL, POINTS, met_in_cells, with_boxes, with_cells
from subsidia.operators.measure import BORDER, flat_rings, with_distances
from subsidia.session import counted, dealt, task_count

_VERTEX = [pa.field("x", pa.float64()), pa.field("y", pa.float64())]
#: Buildings whose areas are one task's work, and areas of whose tables one task takes.
BUILDINGS, AREAS = 5_000, 50_000
#: Outlines that a worker remembers: those of a building serve all its tracks, and buildings of one plan.
REMEMBERED = 4_096


_GROWN: dict[tuple, list[np.ndarray]] = {}
_AREAS: dict[tuple, list[np.ndarray]] = {}


def _all(memory: dict[tuple, list[np.ndarray]], keys: list[tuple], made: Callable[[list[tuple]], list[list[np.ndarray]]]) -> list[list[np.ndarray]]:
    """The outlines of all keys; those that are not in memory are made together, and the oldest forgotten."""
    missing = [k for k in dict.fromkeys(keys) if k not in memory]
    new = dict(zip(missing, made(missing)))
    found = [new[k] if k in new else memory[k] for k in keys]
    memory.update(new)
    for k in list(memory)[: max(0, len(memory) - REMEMBERED)]:
        del memory[k]
    return found


def _areas(rings: pa.Array, shifts: np.ndarray, slack: float, segments: int) -> pa.Array:
    """The area of each polygon; it depends on the vertices as seen from the first one, and on the shift."""
    ring_of, vertex_of, *xy = flat_rings(rings)
    places, origins, keys = np.stack(xy, 1), {}, []
    for i, shift in enumerate(shifts.tolist()):
        ends = vertex_of[ring_of[i] : ring_of[i + 1] + 1]
        if len(ends) > 1 and ends[0] < ends[1]:
            own = places[ends[0] : ends[-1]]
            origins[i] = own[0]
            keys.append(((own - own[0]).tobytes(), tuple(np.diff(ends).tolist()), slack, segments, tuple(shift)))
    polygon = lambda k: np.split(np.frombuffer(k[0]).reshape(-1, 2), np.cumsum(k[1])[:-1])
    grown = lambda ks: _all(_GROWN, [k[:4] for k in ks], lambda ks: overlay.grown([polygon(k) for k in ks], slack, segments))
    areas = dict(zip(origins, _all(_AREAS, keys, lambda ks: overlay.moved_unions(grown(ks), [k[4] for k in ks]))))
    count = [len(areas.get(i, ())) for i in range(len(shifts))]
    found = [r + origins[i] for i, area in areas.items() for r in area]
    starts = lambda sizes: pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    x, y = np.concatenate(found or [np.zeros((0, 2))]).T
    vertices = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)), pa.array(np.ascontiguousarray(y))], fields=_VERTEX)
    return pa.ListArray.from_arrays(starts(count), pa.ListArray.from_arrays(starts([len(r) for r in found]), vertices))


def candidate_areas(buildings: DataFrame, tracks: DataFrame, *, slack: float = 2.0, low: float = 3.0, high: float = 30.0, multiplier: float = 1.0, segments: int = 8, incidence: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each building and track: the range offset, its parts, and ``area``.

    The area is the building's polygon, united with its copy moved away from
    the sensor by the offset, grown by ``slack`` with arcs of ``segments`` a
    quarter.  It comes as rings, even-odd: holes are rings.  Buildings have
    building_id, height and ``rings``; tracks are a small dimension with the
    range vector and default incidence, in place of which ``incidence``
    (building_id, track, incidence_deg) may give a building's own.  Columns of
    ``buildings`` named in ``also`` go along.
    """
    tasks = task_count(buildings, BUILDINGS)
    rows = buildings.where(F.size("rings") > 0).select("building_id", "height", *also, "rings").join(F.broadcast(tracks.select("track", "default_incidence_deg", "range_dx", "range_dy")))
    angle = F.col("default_incidence_deg")
    if incidence is not None:
        rows, angle = rows.join(incidence, ["building_id", "track"], "left"), F.coalesce("incidence_deg", angle)
    rows = rows.withColumn("range_offset_m", range_offset(F.col("height"), angle, multiplier=multiplier, low=low, high=high))
    rows = rows.select("building_id", "track", "range_offset_m", (F.col("range_dx") * F.col("range_offset_m")).alias("shift_x_m"), (F.col("range_dy") * F.col("range_offset_m")).alias("shift_y_m"), *also, "rings")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifts = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("shift_x_m", "shift_y_m")], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _areas(batch["rings"], shifts, slack, segments)], [*batch.schema.names[:-1], "area"])

    kinds = dict(rows.dtypes)
    kept = ", ".join(f"{c} {kinds[c]}" for c in rows.columns if c != "rings")
    # A building's tracks are one after the other, so that its outline is at hand.
    return dealt(rows, "building_id", tasks=tasks).sortWithinPartitions("building_id", "track").mapInArrow(made, f"{kept}, area array<array<struct<x:double,y:double>>>")


def points_in_areas(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(code, track, building_id) of the points (code, track, x_m, y_m) in the areas of their track, over grid cells."""
    areas, seen = counted(areas.select("building_id", "track", F.col("area").alias("rings")), "areas")
    boxed = with_boxes(areas)
    cells = with_cells(boxed, F.col("cx") - F.col("hw"), F.col("cy") - F.col("hh"), F.col("cx") + F.col("hw"), F.col("cy") + F.col("hh")).select("cell_x", "cell_y", "building_id", "track", "cx", "cy", "hw", "hh", "rings")
    placed = points.select("code", "track", "x_m", "y_m", F.floor(F.col("x_m") / CELL).alias("cell_x"), F.floor(F.col("y_m") / CELL).alias("cell_y"))
    tasks = max(task_count(points, POINTS), -(-seen["rows"] // AREAS))
    held = lambda at, middle, half: F.abs(F.col(at) - F.col(middle)) <= F.col(half) + 1e3 * BORDER
    met = met_in_cells(placed, cells, ["cell_x", "cell_y", "track"], tasks).where(held("x_m", "cx", "hw") & held("y_m", "cy", "hh"))
    return with_distances(met.select("code", "track", "building_id", "x_m", "y_m", "rings"), {"distance_m": ("x_m", "y_m")}).where("distance_m = 0").drop("distance_m")
