"""Workers of one's own on the event stream: what one does with the events of a task, and what it keeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Worker:
    """Subclasses say what they emit and keep (DDL), where a task starts, and what to do with its new events."""

    emits = "task_id string"
    keeps = "n long"

    def start(self) -> tuple:
        """The state of a task that has not been seen."""
        raise NotImplementedError

    def process(self, task_id: str, events: pd.DataFrame, state: tuple) -> tuple[list[tuple], tuple]:
        """Rows to emit and the new state, from the task's new events in the order of the log."""
        raise NotImplementedError


def run(stream: DataFrame, worker: Worker) -> DataFrame:
    """What a worker emits over a stream of events; events without a task are left out.

    Spark keeps the state of each task with the query's checkpoint, so a task's events are processed
    once, whichever executor they come to.
    """
    names = [c.split()[0] for c in worker.emits.split(", ")]

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(frames)).sort_values("log_seq", kind="stable")
        rows, now = worker.process(key[0], events, state.get if state.exists else worker.start())
        state.update(now)
        yield pd.DataFrame(rows, columns=names)

    own = stream.where(F.col("task_id").isNotNull())
    return own.groupBy("task_id").applyInPandasWithState(follow, worker.emits, worker.keeps, "append", GroupStateTimeout.NoTimeout)
