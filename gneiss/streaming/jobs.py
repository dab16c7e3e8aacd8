"""Job states over a stream of steps, kept by the engine, and a log of the progress of running queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gneiss.operators.upkeep import TRANSITIONS


def distinct_jobs(submissions: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Submissions (..., ts) without repeats of the same ``keys`` within the lateness bound; the state is dropped with the watermark."""
    return submissions.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def job_states(steps: DataFrame) -> DataFrame:
    """(job_id, state, n_steps, n_broken) of every job with new steps (job_id, ts, state), out of the state kept per job.

    A step that may not follow the state reached is counted as broken and does not change it; a finished job keeps its state.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, n, broken = held.get if held.exists else ("", 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "state"])
        for step in rows["state"]:
            n += 1
            if step in (TRANSITIONS.get(state, ()) if state else ("queued",)):
                state = step
            else:
                broken += 1
        held.update((state, n, broken))
        yield pd.DataFrame({"job_id": [key[0]], "state": [state], "n_steps": [n], "n_broken": [broken]})

    return steps.groupBy("job_id").applyInPandasWithState(advance, "job_id string, state string, n_steps long, n_broken long", "state string, n_steps long, n_broken long", "update", GroupStateTimeout.NoTimeout)


class ProgressLog(StreamingQueryListener):
    """Lines 'key=value ...' of the progress of queries, the last ``most`` of them."""

    def __init__(self, most: int = 1000) -> None:
        self.lines: list[str] = []
        self.most = most

    def _add(self, line: str) -> None:
        self.lines = [*self.lines, line][-self.most :]

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._add(f"event=started query={event.id}")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._add(f"event=progress query={p.id} batch={p.batchId} rows={p.numInputRows}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._add(f"event=idle query={event.id}")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._add(f"event=ended query={event.id} error={'yes' if event.exception else 'no'}")
