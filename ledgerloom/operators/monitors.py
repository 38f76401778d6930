"""Temporal monitors: who is silent, blocked, overdue or stalled at a given moment.

All take ``as_of`` in epoch seconds, so a result can be repeated. One grouped pass derives what
they look at; the monitors are filters over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TERMINAL
from .folds import P, is_type, last, seq


def current_episode(log: DataFrame) -> DataFrame:
    """(task_id, status, since): the state each task is in, and since when without a break.

    The last change to any other state bounds the episode. It is found from the latest event of
    each state, at most eight rows a task, so no task's history is ever sorted in one place.
    """
    moves = log.where(is_type("task.state_changed")).select("task_id", "log_seq", "created_at_ts", F.col(P + "to").alias("to_state"))
    latest = moves.groupBy("task_id", "to_state").agg(F.max("log_seq").alias("s"))
    now = latest.groupBy("task_id").agg(F.max_by("to_state", "s").alias("status"), F.sort_array(F.collect_list("s"), False).alias("ss"))
    bound = now.select("task_id", "status", F.coalesce(F.get("ss", F.lit(1)), F.lit(-1)).alias("after"))
    own = moves.join(bound, "task_id").where("to_state = status AND log_seq > after")
    return own.groupBy("task_id").agg(F.first("status").alias("status"), F.min_by("created_at_ts", "log_seq").alias("since"))


def heartbeat_silence(log: DataFrame, as_of: float, timeout_s: float = 300) -> DataFrame:
    """Tasks in progress without a sign of life for too long, once for each episode."""
    beats = log.where(is_type("agent.heartbeat")).groupBy("task_id").agg(F.max("created_at_ts").alias("beat"))
    rows = current_episode(log).where("status = 'in_progress'").join(beats, "task_id", "left")
    rows = rows.withColumn("last_seen", F.greatest("since", "beat")).withColumn("silent_s", F.lit(as_of) - F.col("last_seen"))
    key = F.concat(F.lit("heartbeat:"), "task_id", F.lit(":"), F.col("since").cast("long").cast("string"))
    return rows.where(F.col("silent_s") > timeout_s).select("task_id", "since", "last_seen", "silent_s", key.alias("idempotency_key"))


def blocked_escalation(log: DataFrame, as_of: float, timeout_s: float = 600) -> DataFrame:
    """Tasks that have been blocked too long, with their owner."""
    owner = log.groupBy("task_id").agg(last(P + "agent", is_type("agent.assigned") & (F.coalesce(P + "role", F.lit("owner")) == "owner")).alias("owner"))
    rows = current_episode(log).where(F.col("status") == "blocked").withColumn("blocked_s", F.lit(as_of) - F.col("since"))
    return rows.where(F.col("blocked_s") > timeout_s).join(owner, "task_id", "left").select("task_id", "owner", "since", "blocked_s")


def deadline_alerts(tasks: DataFrame, as_of: float, lead_s: float = 600, bucket_s: float = 300) -> DataFrame:
    """Of (task_id, status, deadline_ts): open tasks close to their deadline or past it, with the key that dedupes the alert."""
    rows = tasks.where(F.col("deadline_ts").isNotNull() & ~F.col("status").isin(TERMINAL))
    rows = rows.withColumn("remaining_s", F.col("deadline_ts") - F.lit(as_of))
    kind = F.when(F.col("remaining_s") <= 0, "overdue").when(F.col("remaining_s") <= lead_s, "warning")
    key = F.when(kind == "overdue", F.concat(F.lit("deadline:over:"), "task_id")).otherwise(
        F.concat(F.lit("deadline:warn:"), "task_id", F.lit(":"), F.floor(F.col("remaining_s") / bucket_s).cast("string"))
    )
    return rows.where(kind.isNotNull()).select("task_id", "remaining_s", kind.alias("kind"), key.alias("idempotency_key"))


def stalled(log: DataFrame, registry: DataFrame, as_of: float, timeout_s: float = 1800) -> DataFrame:
    """Tasks in progress whose owner is no builtin agent and that nothing has moved for long.

    Tasks handed to the outside, and those already reported, are left out.
    """
    active = is_type("agent.heartbeat", "task.state_changed")
    outside = is_type("handover.created", "agent.transferred")
    state = log.groupBy("task_id").agg(
        last(P + "to", is_type("task.state_changed")).alias("status"),
        last(P + "agent", is_type("agent.assigned") & (F.coalesce(P + "role", F.lit("owner")) == "owner")).alias("owner"),
        F.max(F.when(active, F.col("created_at_ts"))).alias("last_act"),
        F.bool_or(outside).alias("outside"),
        F.bool_or(is_type("task.stalled")).alias("told"),
    )
    builtin = registry.where("executor = 'builtin'").select(F.col("name").alias("owner"))
    rows = state.where((F.col("status") == "in_progress") & ~F.col("outside") & ~F.col("told"))
    rows = rows.where(F.lit(as_of) - F.coalesce("last_act", F.lit(0.0)) >= timeout_s)
    return rows.join(builtin, "owner", "left_anti").select("task_id", "owner", "last_act")


def stale_transfers(letters: DataFrame, log: DataFrame, as_of: float, timeout_s: float = 1800) -> DataFrame:
    """Of (transfer_id, task_id, created_ts): handed over long ago and nothing delivered since."""
    delivered = log.where(is_type("deliverable.submitted")).select("task_id").distinct()
    uuid = "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
    late = letters.where(F.col("task_id").rlike(uuid) & (F.lit(as_of) - F.col("created_ts") > timeout_s))
    return late.join(delivered, "task_id", "left_anti")


def transfer_escalations(late: DataFrame, states: DataFrame) -> DataFrame:
    """The events to emit for stale transfers (transfer_id, task_id): (task_id, step, event, from_state, to_state, idempotency_key).

    Each transfer blocks its task once. The state goes there by legal steps: a task still to do
    starts first. Tasks in any other state than these two are left as they are.
    """
    rows = late.join(states.select("task_id", "status"), "task_id", "left").withColumn("status", F.coalesce("status", F.lit("todo")))
    key = F.concat_ws(":", F.lit("transfer_block"), "task_id", "transfer_id")
    row = lambda step, event, a, b, k: F.struct(F.lit(step).alias("step"), F.lit(event).alias("event"), F.lit(a).alias("from_state"), F.lit(b).alias("to_state"), k.alias("idempotency_key"))
    told = row(0, "task.blocked", None, None, F.concat_ws(":", F.lit("transfer_esc"), "task_id", "transfer_id"))
    start = row(1, "task.state_changed", "todo", "in_progress", F.concat(key, F.lit(":start")))
    block = row(2, "task.state_changed", "in_progress", "blocked", F.concat(key, F.lit(":block")))
    steps = F.when(F.col("status") == "todo", F.array(told, start, block)).when(F.col("status") == "in_progress", F.array(told, block))
    return rows.where(steps.isNotNull()).select("task_id", F.inline(steps))


def auto_starts(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """(task_id, from_state, to_state) of tasks still to do whose dependencies are all done."""
    ready = deps_ready(tasks, states).where("ready").select("task_id")
    todo = tasks.select("task_id").join(states, "task_id", "left").where(F.coalesce("status", F.lit("todo")) == "todo").select("task_id")
    return todo.join(ready, "task_id", "left_semi").select("task_id", F.lit("todo").alias("from_state"), F.lit("in_progress").alias("to_state"))


def deps_ready(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """Of (task_id, depends_on): whether all it depends on is completed or archived; without any it is ready.

    A dependency that does not exist counts as still to do.
    """
    deps = tasks.select("task_id", F.explode_outer("depends_on").alias("dep"))
    seen = states.select(F.col("task_id").alias("dep"), F.col("status").alias("dep_status"))
    done = F.col("dep").isNull() | F.coalesce(F.col("dep_status").isin("completed", "archived"), F.lit(False))
    return deps.join(seen, "dep", "left").groupBy("task_id").agg(F.bool_and(done).alias("ready"), F.count("dep").alias("n_deps"))


def upstream_deliverables(tasks: DataFrame, log: DataFrame, cap: int = 4000) -> DataFrame:
    """Of (task_id, depends_on): the latest deliverable of each upstream task, cut to ``cap`` characters."""
    latest = log.where(is_type("deliverable.submitted") & (F.coalesce(P + "file_ref", F.lit("")) != "")).groupBy(F.col("task_id").alias("dep"))
    latest = latest.agg(F.max_by(P + "file_ref", seq()).alias("file_ref"), F.max("log_seq").alias("last_seq"))
    return tasks.select("task_id", F.explode("depends_on").alias("dep")).join(latest, "dep").withColumn("file_ref", F.substring("file_ref", 1, cap))


def latest_opinions(log: DataFrame) -> DataFrame:
    """(task_id, opinion, verdict) of each task's last review that sent it back and says why."""
    back = is_type("review.decided") & F.col(P + "verdict").isin("needs_changes", "reject")
    given = log.where(back & (F.coalesce(P + "opinion", F.lit("")) != ""))
    return given.groupBy("task_id").agg(F.max_by(P + "opinion", seq()).alias("opinion"), F.max_by(P + "verdict", seq()).alias("verdict"))


def idempotency(log: DataFrame, content: list[str]) -> DataFrame:
    """For each key: the first event that has it, how often it came again, and whether with other content.

    ``content`` leaves out key and time, as those may differ in an honest repetition.
    """
    whole = log.where(F.col("idempotency_key").isNotNull()).select(
        "idempotency_key", "log_seq", F.sha2(F.to_json(F.struct(*content)), 256).alias("content_hash")
    )
    return whole.groupBy("idempotency_key").agg(
        F.min("log_seq").alias("log_seq"),
        F.count("*").alias("n"),
        (F.count_distinct("content_hash") > 1).alias("conflict"),
    )


def minute_dedupe(log: DataFrame) -> DataFrame:
    """Heartbeats of one task and agent within a minute count once, the first."""
    minute = F.floor(F.col("created_at_ts") / 60).alias("minute")
    return log.where(is_type("agent.heartbeat")).groupBy("task_id", "actor", minute).agg(F.min("log_seq").alias("log_seq"), F.count("*").alias("beats"))
