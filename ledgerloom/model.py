"""The event envelope, the closed vocabularies and the state machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The event vocabulary.
EVENT_TYPES = [
    "project.created", "project.paused", "project.archived", "task.created", "task.state_changed", "task.blocked",
    "task.deadline_met", "message.aggregated", "deliverable.submitted", "review.requested", "review.decided",
    "approval.requested", "approval.signers_set", "approval.signed", "approval.decided", "handover.created",
    "agent.assigned", "agent.heartbeat", "agent.transferred", "agent.registered", "goal.parsed", "goal.parse_failed",
    "feedback.submitted", "usage.recorded", "user.registered", "user.logged_in", "agent.execution_failed",
    "task.stalled", "auto.rechecked", "material.uploaded",
]

#: Event types that notify.
NOTIFYING = [
    "task.state_changed", "review.decided", "approval.requested", "approval.signers_set", "approval.signed",
    "approval.decided", "agent.execution_failed", "task.stalled",
]

#: Which states may follow which.
TRANSITIONS = {
    "todo": ["in_progress", "cancelled"],
    "in_progress": ["in_review", "blocked", "cancelled"],
    "blocked": ["in_progress", "cancelled"],
    "in_review": ["in_progress", "pending_approval", "completed"],
    "pending_approval": ["completed", "in_progress", "cancelled"],
    "completed": ["archived"],
    "cancelled": [],
    "archived": [],
}
TERMINAL = ["completed", "cancelled", "archived"]

#: Keys that readers look for in payloads; all may be missing.
PAYLOAD = T.StructType(
    [
        T.StructField(name, kind)
        for kind, names in [
            (T.StringType(), "title goal description status from to trigger verdict opinion reason agent role file_ref summary review_id reviewer approval_id scope initiator rule signer result name capability executor permission provider model label content contact".split()),
            (T.DoubleType(), "deadline_ts rating".split()),
            (T.BooleanType(), ["file_missing"]),
            (T.LongType(), "version input_tokens output_tokens".split()),
            (T.ArrayType(T.StringType()), "deliverables depends_on signers".split()),
        ]
        for name in names
    ]
)

#: A log is ordered by log_seq and by nothing else; time only measures what has passed.
EVENT = T.StructType(
    [
        T.StructField("log_seq", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("idempotency_key", T.StringType()),
        T.StructField("created_at_ts", T.DoubleType()),
        T.StructField("payload", PAYLOAD),
    ]
)


def transition_table(spark: SparkSession) -> DataFrame:
    """(from_state, to_state), the 14 legal pairs."""
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_state string, to_state string")


def events_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A log from dicts in order, for tests and small imports; missing keys are null."""
    names, inner = [f.name for f in EVENT], [f.name for f in PAYLOAD]
    data = []
    for seq, row in enumerate(rows, 1):
        row = {"log_seq": seq} | row
        payload = row.get("payload") or {}
        if unknown := set(payload) - set(inner):
            raise ValueError(f"unknown payload keys: {sorted(unknown)}")
        data.append(tuple(tuple(payload.get(k) for k in inner) if n == "payload" else row.get(n) for n in names))
    return spark.createDataFrame(data, EVENT)
