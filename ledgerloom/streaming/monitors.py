"""Monitors over the event stream: alerts when a task stays too long in a state without a sign of life.

Event time moves by the watermark, so a replay gives the same alerts. The state is one small row for
each task; Spark keeps it in its state store and brings it back after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import P
from .readmodels import ReadModel

ALERT = "task_id string, status string, owner string, since double, last_seen double, idempotency_key string"
_STATE = "status string, since double, seen double, told boolean, owner string, gone boolean"


def episode_alerts(stream: DataFrame, watched: str, life: list[str], timeout_s: float, name: str, late: str = "10 minutes", leaves: Sequence[str] = (), once: bool = False) -> DataFrame:
    """One alert for each time that a task is in state ``watched`` for longer than ``timeout_s`` without an event of ``life``.

    An episode begins with the change into the state and ends with one into another; the key has its
    beginning, so a repeated alert can be told. The task's owner is kept beside it, by the last
    assignment of one. With an event of ``leaves`` a task is looked at no more; with ``once`` it is told
    once for good, and every change of state is a sign of life. What counts is the time of the
    events that are followed here, so batches may be cut anywhere. Events later than ``late`` may be
    missed.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, since, seen, told, owner, gone = state.get if state.exists else (None, 0.0, 0.0, False, None, False)
        events = [] if state.hasTimedOut else pd.concat(list(frames)).sort_values("log_seq").itertuples()
        rows = []

        def check(now: float) -> None:
            """Tell if the open episode has been without a sign of life for too long by then."""
            nonlocal told
            if status == watched and not told and not gone and now > seen + timeout_s:
                told = True
                rows.append((key[0], status, owner, since, seen, f"{name}:{key[0]}" + ("" if once else f":{int(since)}")))

        for e in events:
            check(e.created_at_ts)
            if e.event_type == "task.state_changed":
                if e.to != status:
                    status, since, told = e.to, e.created_at_ts, told and once
                    seen = max(seen, e.created_at_ts) if once else e.created_at_ts
                elif once:
                    seen = max(seen, e.created_at_ts)
            elif e.event_type == "agent.assigned":
                owner = e.agent
            elif e.event_type in leaves:
                gone = True
            elif e.event_type in life:
                seen = max(seen, e.created_at_ts)
        check(state.getCurrentWatermarkMs() / 1000)
        state.update((status, since, seen, told, owner, gone))
        if status == watched and not told and not gone:
            # A time that has passed already is looked at with the next step of the watermark.
            state.setTimeoutTimestamp(max(int((seen + timeout_s) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALERT.split(", ")])

    assigned = (F.col("event_type") == "agent.assigned") & (F.coalesce(P + "role", F.lit("owner")) == "owner")
    timed = stream.where(F.col("task_id").isNotNull() & (F.col("event_type").isin("task.state_changed", *life, *leaves) | assigned))
    timed = timed.select("task_id", "log_seq", "event_type", F.col(P + "to").alias("to"), F.col(P + "agent").alias("agent"), "created_at_ts", F.timestamp_seconds("created_at_ts").alias("at"))
    return timed.withWatermark("at", late).groupBy("task_id").applyInPandasWithState(follow, ALERT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def silent_tasks(stream: DataFrame, timeout_s: float = 300, late: str = "10 minutes") -> DataFrame:
    """Tasks in progress without a heartbeat."""
    return episode_alerts(stream, "in_progress", ["agent.heartbeat"], timeout_s, "heartbeat", late)


def blocked_tasks(stream: DataFrame, timeout_s: float = 600, late: str = "10 minutes") -> DataFrame:
    """Tasks that stay blocked, with their owner; as ``operators.monitors.blocked_escalation`` tells them."""
    return episode_alerts(stream, "blocked", [], timeout_s, "blocked", late)


def stalled_tasks(stream: DataFrame, timeout_s: float = 1800, late: str = "10 minutes") -> DataFrame:
    """Tasks in progress that nothing moves, each told once, with their owner.

    As ``operators.monitors.stalled`` tells them: heartbeats and changes of state are signs of life, and
    tasks that were handed to the outside or reported before are left out. Builtin owners are not
    known here; ``run_stalled`` leaves theirs out.
    """
    return episode_alerts(stream, "in_progress", ["agent.heartbeat"], timeout_s, "stall", late, leaves=["handover.created", "agent.transferred", "task.stalled"], once=True)


def run_stalled(stream: DataFrame, registry: ReadModel, path: str, checkpoint: str, timeout_s: float = 1800, late: str = "10 minutes") -> tuple[StreamingQuery, StreamingQuery]:
    """Follow the registrations and the tasks of one stream, and write the alerts of ``stalled_tasks`` to ``path``, batch by batch.

    The registry is a read model of its own, brought up to date before the tasks are looked at; an alert
    is held against it as it is then. A batch that comes again overwrites its own alerts.
    """
    from .readmodels import refresh, registrations

    agents = refresh(registrations(stream), registry, f"{checkpoint}/registry")
    agents.awaitTermination()

    def write(alerts: DataFrame, number: int) -> None:
        known = registry.read(alerts.sparkSession)
        if known is not None:
            alerts = alerts.join(known.where("executor = 'builtin'").select(F.col("name").alias("owner")), "owner", "left_anti")
        alerts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    found = stalled_tasks(stream, timeout_s, late)
    return agents, found.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/tasks").trigger(availableNow=True).start()


def deadline_tasks(stream: DataFrame, lead_s: float = 600, late: str = "10 minutes") -> DataFrame:
    """(task_id, kind, deadline_ts, idempotency_key): a warning before a task's deadline and an alert after it.

    The deadline is that of the last creation that gives one. Tasks that are over by then get none.
    """
    from ..model import TERMINAL

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        deadline, over, told = state.get if state.exists else (None, False, 0)
        events = [] if state.hasTimedOut else pd.concat(list(frames)).sort_values("log_seq").itertuples()
        rows = []

        def check(now: float) -> float | None:
            """Tell what is due by then; when the next is."""
            nonlocal told
            for step, kind, due in ((1, "warning", (deadline or 0.0) - lead_s), (2, "overdue", deadline or 0.0)):
                if deadline is not None and not over and told < step:
                    if due > now:
                        return due
                    told = step
                    rows.append((key[0], kind, deadline, f"deadline:{kind}:{key[0]}:{int(deadline)}"))
            return None

        for e in events:
            check(e.created_at_ts)
            if e.event_type == "task.created" and pd.notna(e.deadline_ts):
                deadline = float(e.deadline_ts)
            elif e.event_type == "task.state_changed":
                over = e.to in TERMINAL
        due = check(state.getCurrentWatermarkMs() / 1000)
        state.update((deadline, over, told))
        if due is not None:
            state.setTimeoutTimestamp(int(due * 1000) + 1)
        yield pd.DataFrame(rows, columns=["task_id", "kind", "deadline_ts", "idempotency_key"])

    timed = stream.where(F.col("task_id").isNotNull() & F.col("event_type").isin("task.created", "task.state_changed"))
    timed = timed.select("task_id", "log_seq", "event_type", F.col(P + "to").alias("to"), F.col(P + "deadline_ts").alias("deadline_ts"), "created_at_ts", F.timestamp_seconds("created_at_ts").alias("at"))
    schema, kept = "task_id string, kind string, deadline_ts double, idempotency_key string", "deadline double, over boolean, told int"
    return timed.withWatermark("at", late).groupBy("task_id").applyInPandasWithState(follow, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)
