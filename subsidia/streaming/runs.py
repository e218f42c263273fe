"""The state of runs from the log of their events, as a table and as a stream.

A run is queued, then running, then succeeded or failed, or fails while it is
queued.  Events are taken in order of their time, whatever order they arrive
in; one that its run's state does not allow is refused, and one that comes
after the run has ended is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States that may follow a state; runs begin with the empty one.
FOLLOWERS = {"": ("queued", "running"), "queued": ("running", "failed"), "running": ("succeeded", "failed")}
ENDS = ("succeeded", "failed")
SCHEMA = "run_id string, status string, since timestamp, refused int, late int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _next(state: Column, event: Column) -> Column:
    allowed = F.lit(False)
    for before, after in FOLLOWERS.items():
        allowed = allowed | ((state["status"] == before) & event["status"].isin(*after))
    ended = state["status"].isin(*ENDS)
    return F.struct(
        F.when(allowed, event["status"]).otherwise(state["status"]).alias("status"), F.when(allowed, event["at"]).otherwise(state["since"]).alias("since"),
        (state["refused"] + (~allowed & ~ended).cast("int")).alias("refused"), (state["late"] + ended.cast("int")).alias("late"),
    )


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, status, since, refused, late) of a table of events (run_id, at, number, status); a run none of whose events is allowed has no status."""
    start = F.struct(F.lit("").alias("status"), F.lit(None).cast("timestamp").alias("since"), F.lit(0).alias("refused"), F.lit(0).alias("late"))
    log = events.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("at", "number", "status"))).alias("log"))
    state = log.select("run_id", F.aggregate("log", start, _next).alias("s"))
    return state.select("run_id", F.nullif("s.status", F.lit("")).alias("status"), "s.since", "s.refused", "s.late")


class RunStates(StatefulProcessor):
    """Keeps the events of each run, which are few, and gives its state anew when others arrive."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "at timestamp, number long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.log.appendList([(a.to_pydatetime(), int(n), s) for a, n, s in zip(batch["at"], batch["number"], batch["status"])])
        status, since, refused, late = "", None, 0, 0
        for at, _, event in sorted(self.log.get()):
            if status in ENDS:
                late += 1
            elif event in FOLLOWERS[status]:
                status, since = event, at
            else:
                refused += 1
        yield pd.DataFrame({"run_id": [key[0]], "status": [status or None], "since": pd.Series([since], dtype="datetime64[us]"), "refused": [refused], "late": [late]})

    def close(self) -> None:
        pass


def stream_run_states(events: DataFrame) -> DataFrame:
    """The same of a stream, for update mode: the state of each run that got events.  Needs ``PROVIDER`` as the session's state store."""
    return events.groupBy("run_id").transformWithStateInPandas(RunStates(), SCHEMA, "Update", "None")
