"""Read models: an event log folded into one row for each entity.

Every fold is one grouped aggregation. What a loop over the log would overwrite is the value with
the greatest log_seq; Spark combines it before the shuffle, so a task with very many events costs
its group no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import with_earlier_blocks, with_previous

P = "payload."


def kind() -> Column:
    return F.col("event_type")


def seq() -> Column:
    return F.col("log_seq")


def last(value: Column | str, when: Column) -> Column:
    """The value at the latest event for which ``when`` holds; null if there is none."""
    return F.max_by(value, F.when(when, seq()))


def first(value: Column | str, when: Column) -> Column:
    return F.min_by(value, F.when(when, seq()))


def is_type(*names: str) -> Column:
    return kind() == names[0] if len(names) == 1 else kind().isin(list(names))


def project_list(log: DataFrame, viewer: str | None = None) -> DataFrame:
    """Projects by their last creation; paused or archived after it; archived ones are left out.

    A creation without an owner or goal leaves those that an earlier one gave. With a viewer only the
    own projects are seen; None sees all.
    """
    created, stopped = is_type("project.created"), is_type("project.paused", "project.archived")
    status = F.when(kind() == "project.paused", "paused").otherwise("archived")
    rows = log.where(created | stopped).groupBy("project_id").agg(
        last(P + "title", created).alias("title"),
        last(P + "goal", created & F.col(P + "goal").isNotNull()).alias("goal"),
        last("user_id", created & F.col("user_id").isNotNull()).alias("owner"),
        F.max(F.when(created, seq())).alias("made"),
        last(status, stopped).alias("stop"),
        F.max(F.when(stopped, seq())).alias("stopped"),
    )
    rows = rows.where("made IS NOT NULL").select(
        "project_id", "title", "goal", "owner", F.when(F.col("stopped") > F.col("made"), F.col("stop")).otherwise("active").alias("status")
    )
    rows = rows.where("status <> 'archived'")
    return rows if viewer is None else rows.where(F.col("owner") == viewer)


def task_board(log: DataFrame, orphans: bool = True) -> DataFrame:
    """One row for each task: title, owner, reviewer, status and whether anything was delivered.

    Without ``orphans`` only tasks of a project are on it.

    A missing role means owner, any other than owner means reviewer; a missing status means todo.
    Without an event that creates it a task is not on the board.
    """
    created, assigned = is_type("task.created"), is_type("agent.assigned")
    owner = assigned & (F.coalesce(P + "role", F.lit("owner")) == "owner")
    return (
        log.where(F.col("task_id").isNotNull())
        .groupBy("task_id")
        .agg(
            F.max(F.when(created, seq())).alias("made"),
            last("project_id", created).alias("project_id"),
            last(P + "title", created).alias("title"),
            last(P + "agent", owner).alias("owner"),
            last(P + "agent", assigned & ~owner).alias("reviewer"),
            F.coalesce(last(P + "to", is_type("task.state_changed")), F.lit("todo")).alias("status"),
            F.bool_or(is_type("deliverable.submitted")).alias("has_deliverable"),
            F.count_if(is_type("task.state_changed")).alias("version"),
        )
        .where("made IS NOT NULL" if orphans else "made IS NOT NULL AND project_id IS NOT NULL")
        .drop("made")
    )


def task_context(log: DataFrame) -> DataFrame:
    """What an executor needs: description, deliverables in order and deadline beside the board's columns."""
    created = is_type("task.created")
    more = log.groupBy("task_id").agg(
        F.coalesce(last(P + "description", created), F.lit("")).alias("description"),
        last(P + "deadline_ts", created & F.col(P + "deadline_ts").isNotNull()).alias("deadline_ts"),
        F.transform(
            F.array_sort(F.collect_list(F.when(is_type("deliverable.submitted"), F.struct(seq().alias("s"), F.col(P + "file_ref").alias("f"))))), lambda x: x.f
        ).alias("deliverables"),
    )
    return task_board(log).join(more, "task_id")


def project_of_task(log: DataFrame) -> DataFrame:
    return log.where(is_type("task.created")).groupBy("task_id").agg(F.min_by("project_id", seq()).alias("project_id"))


def project_owner(log: DataFrame) -> DataFrame:
    return log.where(is_type("project.created") & F.col("user_id").isNotNull()).groupBy("project_id").agg(F.min_by("user_id", seq()).alias("owner"))


def project_context(log: DataFrame) -> DataFrame:
    """Goal and number of project-level events."""
    own = log.where(kind().startswith("project."))
    return own.groupBy("project_id").agg(first(P + "goal", is_type("project.created")).alias("goal"), F.count("*").alias("event_count"))


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, whole."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def agent_registry(log: DataFrame) -> DataFrame:
    """Agents by their last registration; a missing executor means builtin."""
    rows = log.where(is_type("agent.registered") & F.col(P + "name").isNotNull()).select(
        F.col(P + "name").alias("name"), "log_seq", F.col(P + "capability").alias("capability"), F.col(P + "role").alias("role"),
        F.coalesce(P + "status", F.lit("available")).alias("status"), F.coalesce(P + "executor", F.lit("builtin")).alias("executor"),
    )
    return latest_by(rows, "name", "log_seq").drop("log_seq")


def usage(log: DataFrame) -> DataFrame:
    """Calls and tokens in all (label null) and by label, in one pass; an empty label counts as '?'."""
    facts = log.where(is_type("usage.recorded")).select(
        F.coalesce(F.nullif(F.col(P + "label"), F.lit("")), F.lit("?")).alias("label"),
        F.coalesce(P + "input_tokens", F.lit(0)).alias("i"),
        F.coalesce(P + "output_tokens", F.lit(0)).alias("o"),
    )
    sums = [F.count("*").alias("calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.grouping("label").alias("is_total")]
    return facts.rollup("label").agg(*sums)


def deliverable_versions(log: DataFrame) -> DataFrame:
    """Deliverables of each task numbered from 1 in order."""
    rows = log.where(is_type("deliverable.submitted")).select("task_id", "log_seq", F.col(P + "file_ref").alias("file_ref"))
    rows = with_earlier_blocks(rows, "task_id", "log_seq", F.lit(1))
    place = F.row_number().over(W.partitionBy("task_id", "block").orderBy("log_seq")) + F.col("before")
    return rows.select("task_id", "log_seq", "file_ref", place.cast("int").alias("version"))


def rework_counts(log: DataFrame, limit: int = 3) -> DataFrame:
    """How often each task was sent back, and whether it stops being retried."""
    back = is_type("review.decided") & F.col(P + "verdict").isin("reject", "needs_changes")
    n = log.where(F.col("task_id").isNotNull()).groupBy("task_id").agg(F.count_if(back).alias("reworks"))
    return n.withColumn("stopped", F.col("reworks") >= limit)


def illegal_transitions(log: DataFrame, legal: DataFrame) -> DataFrame:
    """State changes that the state machine does not allow from the state the task was in."""
    moves = log.where(is_type("task.state_changed")).select("task_id", "log_seq", F.col(P + "to").alias("to_state"))
    moves = with_previous(moves, "task_id", "log_seq", "to_state", "from_state", default="todo")
    return moves.where("from_state <> to_state").select("from_state", "to_state", "task_id", "log_seq").join(legal, ["from_state", "to_state"], "left_anti")


def open_reviews(log: DataFrame) -> DataFrame:
    """Reviews that were asked for and not decided."""
    asked = log.where(is_type("review.requested")).select("task_id", F.col(P + "review_id").alias("review_id")).distinct()
    decided = log.where(is_type("review.decided")).select(F.col(P + "review_id").alias("review_id"))
    return asked.join(decided, "review_id", "left_anti")


def feedback(log: DataFrame) -> DataFrame:
    return log.where(is_type("feedback.submitted")).select("log_seq", "task_id", F.col(P + "content").alias("content"), F.col(P + "rating").alias("rating")).orderBy(F.desc("log_seq"))


def project_materials(materials: DataFrame, cap: int = 60_000) -> DataFrame:
    """Texts (project_id, log_seq, text) in order of upload up to ``cap`` characters; the last is cut, later ones go.

    Blocks of uploads that begin beyond the cap go before anything is sorted.
    """
    rows = with_earlier_blocks(materials, "project_id", "log_seq", F.length("text")).where(F.col("before") < cap)
    inside = F.sum(F.length("text")).over(W.partitionBy("project_id", "block").orderBy("log_seq").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("room", F.lit(cap) - F.col("before") - F.coalesce(inside, F.lit(0))).where("room > 0")
    return rows.withColumn("text", F.expr("substring(text, 1, CAST(room AS INT))")).drop("room", "block", "before")


def notifications(log: DataFrame, viewer: str | None, viewer_name: str | None = None, owners: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """The latest events that concern a viewer: of own projects, or of approvals to sign."""
    from ..model import NOTIFYING

    owners = project_owner(log) if owners is None else owners
    asked = log.where(is_type("approval.requested", "approval.signers_set")).groupBy(F.col(P + "approval_id").alias("approval_id"))
    signers = asked.agg(F.max_by(P + "signers", seq()).alias("signers"))
    rows = log.where(kind().isin(NOTIFYING)).select("*", F.col(P + "approval_id").alias("approval_id"))
    rows = rows.join(owners, "project_id", "left").join(signers, "approval_id", "left")
    mine = F.lit(viewer is None) | (F.col("owner") == F.lit(viewer))
    if viewer_name:
        mine = F.coalesce(mine, F.lit(False)) | F.array_contains("signers", viewer_name)
    rows = rows.where(mine).select("log_seq", "event_type", "project_id", "task_id", "approval_id", summary().alias("summary"), "created_at_ts")
    return rows.orderBy(F.desc("created_at_ts"), "log_seq").limit(limit)


def summary() -> Column:
    """One line about a notifying event."""
    approve = F.col(P + "result") == "approve"
    return (
        F.when(kind() == "task.state_changed", F.concat(F.lit("任务状态 → "), F.coalesce(P + "to", F.lit("?"))))
        .when(kind() == "review.decided", F.concat(F.lit("复核结论: "), F.coalesce(P + "verdict", F.lit("?"))))
        .when(
            (kind() == "approval.requested") & (F.size(F.col(P + "signers")) > 0),
            F.concat(F.lit("会签请求（"), F.size(P + "signers").cast("string"), F.lit(" 人）："), F.coalesce(P + "scope", F.lit(""))),
        )
        .when(kind() == "approval.requested", F.concat(F.lit("审批请求："), F.coalesce(P + "scope", F.lit(""))))
        .when(
            kind() == "approval.signers_set",
            F.concat(F.lit("会签人已设置（"), F.coalesce(F.size(P + "signers"), F.lit(0)).cast("string"), F.lit(" 人）："), F.coalesce(F.array_join(P + "signers", "、"), F.lit(""))),
        )
        .when(kind() == "approval.signed", F.concat(F.lit("会签："), F.coalesce(P + "signer", F.lit("?")), F.when(approve, " 已同意").otherwise(" 已驳回")))
        .when(kind() == "approval.decided", F.when(approve, "审批: 已批准").otherwise("审批: 已拒绝"))
        .otherwise("")
    )
