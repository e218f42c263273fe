"""Groups of rows handed to Arrow many at a time.

A Python call for each group costs about a millisecond whatever it holds, more
than the work on a group of a few rows.  Here rows are dealt by their keys and
sorted, and a call gets all the groups that end in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Places where a new group begins, and the number of rows."""
    changed = np.zeros(len(rows), bool)
    changed[:1] = True
    for key in keys:
        codes = pc.fill_null(pc.dictionary_encode(rows[key].combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
        changed[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(changed), len(rows))


def in_groups(rows: DataFrame, keys: list[str], order: list[str], made: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``made`` over whole groups: a table of rows by ``keys`` and then ``order``, and where its groups start.

    A task holds a batch and the group that runs over its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            if held:
                ends = pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1), batch.slice(len(batch) - 1)])
                if len(group_starts(ends, keys)) == 2:  # the batch is all of the group that is open
                    held.append(batch)
                    continue
            table = pa.Table.from_batches([*held, batch])
            starts = group_starts(table, keys)
            open_ = int(starts[-2])
            if open_:
                yield from made(table.slice(0, open_), starts[:-1]).to_batches()
            held = table.slice(open_).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from made(table, group_starts(table, keys)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
