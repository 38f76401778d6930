"""Queries over the event log: read models, monitors, approvals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import EVENT, PAYLOAD, TRANSITIONS, transition_table
from ..operators import approvals as ap
from ..operators import folds, monitors
from ..operators.folds import P, is_type
from ..sources.tables import LOG_SQL, event_log, table
from .catalog import query

#: 2024-01-31 00:00:00 UTC, one day after the last event.
AS_OF = 1706659200.0
HOUR = 3600.0
LOG = f"WITH log AS ({LOG_SQL})"
_STATE = "event_type = 'task.state_changed'"
_OWNER = "event_type = 'agent.assigned' AND role = 'owner'"


@query(f"""{LOG} SELECT task_id, arg_max(project_id, log_seq) FILTER (WHERE event_type = 'task.created') AS project_id,
  arg_max(title, log_seq) FILTER (WHERE event_type = 'task.created') AS title,
  arg_max(agent, log_seq) FILTER (WHERE {_OWNER}) AS owner,
  arg_max(agent, log_seq) FILTER (WHERE event_type = 'agent.assigned' AND role <> 'owner') AS reviewer,
  coalesce(arg_max(to_state, log_seq) FILTER (WHERE {_STATE}), 'todo') AS status,
  bool_or(event_type = 'deliverable.submitted') AS has_deliverable, count(*) FILTER (WHERE {_STATE}) AS version
  FROM log GROUP BY task_id HAVING count(*) FILTER (WHERE event_type = 'task.created') > 0""")
def task_board(spark, sf_dir):
    return folds.task_board(event_log(spark, sf_dir))


@query(f"""{LOG}, b AS (SELECT task_id, coalesce(arg_max(to_state, log_seq) FILTER (WHERE {_STATE}), 'todo') AS status,
  arg_max(title, log_seq) FILTER (WHERE event_type = 'task.created') AS title,
  string_agg(file_ref, ',' ORDER BY log_seq) FILTER (WHERE event_type = 'deliverable.submitted') AS deliverables
  FROM log GROUP BY task_id HAVING count(*) FILTER (WHERE event_type = 'task.created') > 0)
  SELECT task_id, title, status, '' AS description, coalesce(deliverables, '') AS deliverables FROM b""")
def task_context(spark, sf_dir):
    rows = folds.task_context(event_log(spark, sf_dir))
    return rows.select("task_id", "title", "status", "description", F.array_join("deliverables", ",").alias("deliverables"))


def _projects(spark, sf_dir):
    """Orders read as the life of projects: open ones create, others pause or archive."""
    kind = F.when(F.col("o_orderstatus") == "O", "project.created").when(F.col("o_orderstatus") == "P", "project.paused").otherwise("project.archived")
    given = {"title": F.col("o_orderpriority"), "goal": F.col("o_orderstatus")}
    payload = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAYLOAD])
    own = {
        "log_seq": F.col("o_orderkey"),
        "event_type": kind,
        "project_id": (F.col("o_orderkey") % 997).cast("string"),
        "user_id": (F.col("o_custkey") % 20).cast("string"),
        "payload": payload,
    }
    return table(spark, sf_dir, "orders").select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT])


_PROJECTS = """WITH log AS (SELECT o_orderkey AS log_seq, CAST(o_orderkey % 997 AS VARCHAR) AS project_id, CAST(o_custkey % 20 AS VARCHAR) AS user_id,
  o_orderpriority AS title, o_orderstatus AS goal,
  CASE o_orderstatus WHEN 'O' THEN 'project.created' WHEN 'P' THEN 'project.paused' ELSE 'project.archived' END AS event_type FROM orders)"""


@query(f"""{_PROJECTS}, p AS (SELECT project_id, arg_max(title, log_seq) FILTER (WHERE event_type = 'project.created') AS title,
  arg_max(goal, log_seq) FILTER (WHERE event_type = 'project.created') AS goal,
  arg_max(user_id, log_seq) FILTER (WHERE event_type = 'project.created') AS owner,
  max(log_seq) FILTER (WHERE event_type = 'project.created') AS made,
  max(log_seq) FILTER (WHERE event_type <> 'project.created') AS stopped,
  arg_max(event_type, log_seq) FILTER (WHERE event_type <> 'project.created') AS stop FROM log GROUP BY project_id)
  SELECT project_id, title, goal, owner, CASE WHEN stopped > made THEN 'paused' ELSE 'active' END AS status FROM p
  WHERE made IS NOT NULL AND owner = '7' AND NOT (coalesce(stopped > made, false) AND stop = 'project.archived')""")
def project_list_rls(spark, sf_dir):
    return folds.project_list(_projects(spark, sf_dir), viewer="7")


@query(f"""{_PROJECTS} SELECT project_id, arg_min(goal, log_seq) FILTER (WHERE event_type = 'project.created') AS goal, count(*) AS event_count
  FROM log GROUP BY project_id""")
def project_context(spark, sf_dir):
    return folds.project_context(_projects(spark, sf_dir))


@query(f"{_PROJECTS} SELECT project_id, arg_min(user_id, log_seq) AS owner FROM log WHERE event_type = 'project.created' GROUP BY project_id")
def project_owner(spark, sf_dir):
    return folds.project_owner(_projects(spark, sf_dir))


@query(f"{LOG} SELECT project_id, count(*) AS n_events, count(DISTINCT task_id) AS n_tasks FROM log GROUP BY project_id")
def project_event_counts(spark, sf_dir):
    return event_log(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("n_events"), F.count_distinct("task_id").alias("n_tasks"))


@query(f"{LOG} SELECT DISTINCT task_id FROM log")
def distinct_tasks(spark, sf_dir):
    return event_log(spark, sf_dir).select("task_id").distinct()


@query(f"{LOG} SELECT task_id, arg_min(project_id, log_seq) AS project_id FROM log WHERE event_type = 'task.created' GROUP BY task_id")
def project_of_task(spark, sf_dir):
    return folds.project_of_task(event_log(spark, sf_dir))


@query("""SELECT s_nationkey AS name, s_suppkey AS log_seq, s_name AS capability FROM
  (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS r FROM supplier) WHERE r = 1""")
def registry_latest_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("log_seq"), F.col("s_name").alias("capability"))
    return folds.latest_by(rows, "name", "log_seq")


@query("""SELECT l_returnflag AS label, count(*) AS calls, sum(CAST(l_quantity AS BIGINT)) AS input_tokens, sum(CAST(l_linenumber AS BIGINT)) AS output_tokens,
  CAST(grouping(l_returnflag) AS TINYINT) AS is_total FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag))""")
def usage_rollup(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    given = {"label": F.col("l_returnflag"), "input_tokens": F.col("l_quantity"), "output_tokens": F.col("l_linenumber")}
    payload = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAYLOAD])
    return folds.usage(line.select(F.lit("usage.recorded").alias("event_type"), payload.alias("payload")))


@query(f"""{LOG} SELECT task_id, log_seq, file_ref, row_number() OVER (PARTITION BY task_id ORDER BY log_seq) AS version
  FROM log WHERE event_type = 'deliverable.submitted'""")
def deliverable_versions(spark, sf_dir):
    return folds.deliverable_versions(event_log(spark, sf_dir))


@query(f"""{LOG}, n AS (SELECT task_id, count(*) FILTER (WHERE event_type = 'review.decided' AND verdict IN ('reject', 'needs_changes')) AS reworks
  FROM log GROUP BY task_id) SELECT task_id, reworks, reworks >= 3 AS stopped FROM n""")
def rework_counts(spark, sf_dir):
    return folds.rework_counts(event_log(spark, sf_dir))


_LEGAL = " OR ".join(f"(from_state = '{a}' AND to_state IN ({', '.join(repr(b) for b in bs)}))" for a, bs in TRANSITIONS.items() if bs)


@query(f"""{LOG}, m AS (SELECT task_id, log_seq, lag(to_state, 1, 'todo') OVER (PARTITION BY task_id ORDER BY log_seq) AS from_state, to_state
  FROM log WHERE {_STATE}) SELECT * FROM m WHERE from_state <> to_state AND NOT ({_LEGAL})""")
def illegal_transitions(spark, sf_dir):
    return folds.illegal_transitions(event_log(spark, sf_dir), transition_table(spark))


@query(f"""{LOG} SELECT DISTINCT review_id, task_id FROM log WHERE event_type = 'review.requested'
  AND review_id NOT IN (SELECT review_id FROM log WHERE event_type = 'review.decided')""")
def open_reviews_anti(spark, sf_dir):
    return folds.open_reviews(event_log(spark, sf_dir))


@query(f"""{LOG}, o AS (SELECT project_id, min_by(task_id, log_seq) AS owner FROM log WHERE event_type = 'task.created' GROUP BY project_id)
  SELECT log_seq, event_type, log.project_id, log.task_id, CASE event_type WHEN 'task.state_changed' THEN '任务状态 → ' || to_state ELSE '复核结论: ' || verdict END AS summary
  FROM log JOIN o USING (project_id) WHERE event_type IN ('task.state_changed', 'review.decided') AND owner = (SELECT min(owner) FROM o)
  ORDER BY at_us DESC, log_seq LIMIT 20""")
def notifications_top20(spark, sf_dir):
    log = event_log(spark, sf_dir)
    owners = log.where(is_type("task.created")).groupBy("project_id").agg(F.min_by("task_id", "log_seq").alias("owner"))
    viewer = owners.agg(F.min("owner")).first()[0]
    return folds.notifications(log, viewer, owners=owners).select("log_seq", "event_type", "project_id", "task_id", "summary")


@query(f"""{LOG}, o AS (SELECT task_id, min_by(project_id, log_seq) AS owner FROM log WHERE event_type = 'task.created' GROUP BY task_id)
  SELECT log_seq, event_type, owner FROM log LEFT JOIN o USING (task_id)""")
def owner_join(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return log.select("log_seq", "event_type", "task_id").join(folds.project_of_task(log), "task_id", "left").select("log_seq", "event_type", F.col("project_id").alias("owner"))


@query(f"{LOG} SELECT log_seq, task_id, file_ref AS content FROM log WHERE event_type = 'feedback.submitted'")
def feedback_newest(spark, sf_dir):
    return folds.feedback(event_log(spark, sf_dir)).select("log_seq", "task_id", "content")


@query(f"{LOG} SELECT log_seq, task_id, event_type FROM log WHERE project_id = '3' ORDER BY log_seq DESC LIMIT 20")
def audit_tail(spark, sf_dir):
    log = event_log(spark, sf_dir).where(F.col("project_id") == "3")
    return log.select("log_seq", "task_id", "event_type").orderBy(F.desc("log_seq")).limit(20)


_EPISODE = f"""moves AS (SELECT * FROM log WHERE {_STATE}),
  now AS (SELECT task_id, arg_max(to_state, log_seq) AS status FROM moves GROUP BY task_id),
  bound AS (SELECT task_id, status, max(log_seq) FILTER (WHERE to_state <> status) AS after FROM moves JOIN now USING (task_id) GROUP BY ALL),
  episode AS (SELECT task_id, status, min(at_us) / 1e6 AS since FROM moves JOIN bound USING (task_id) WHERE to_state = status AND log_seq > coalesce(after, -1) GROUP BY ALL)"""


@query(f"{LOG}, {_EPISODE} SELECT task_id, status, since FROM episode")
def current_episode(spark, sf_dir):
    return monitors.current_episode(event_log(spark, sf_dir))


@query(f"""{LOG}, {_EPISODE}, beats AS (SELECT task_id, max(at_us) / 1e6 AS beat FROM log WHERE event_type = 'agent.heartbeat' GROUP BY task_id)
  SELECT task_id, since, greatest(since, coalesce(beat, since)) AS last_seen, {AS_OF} - greatest(since, coalesce(beat, since)) AS silent_s
  FROM episode LEFT JOIN beats USING (task_id) WHERE status = 'in_progress' AND {AS_OF} - greatest(since, coalesce(beat, since)) > {24 * HOUR}""")
def heartbeat_silence(spark, sf_dir):
    return monitors.heartbeat_silence(event_log(spark, sf_dir), AS_OF, 24 * HOUR).drop("idempotency_key")


@query(f"""{LOG}, {_EPISODE}, o AS (SELECT task_id, arg_max(agent, log_seq) FILTER (WHERE {_OWNER}) AS owner FROM log GROUP BY task_id)
  SELECT task_id, owner, since, {AS_OF} - since AS blocked_s FROM episode LEFT JOIN o USING (task_id) WHERE status = 'blocked' AND {AS_OF} - since > {36 * HOUR}""")
def blocked_escalation(spark, sf_dir):
    return monitors.blocked_escalation(event_log(spark, sf_dir), AS_OF, 36 * HOUR)


@query(f"""{LOG}, t AS (SELECT task_id, coalesce(arg_max(to_state, log_seq) FILTER (WHERE {_STATE}), 'todo') AS status, min(at_us) / 1e6 + {29.5 * 24 * HOUR} - {AS_OF} AS remaining_s
  FROM log GROUP BY task_id), k AS (SELECT *, CASE WHEN remaining_s <= 0 THEN 'overdue' WHEN remaining_s <= {12 * HOUR} THEN 'warning' END AS kind FROM t WHERE status <> 'completed')
  SELECT task_id, kind, CASE kind WHEN 'overdue' THEN 'deadline:over:' || task_id ELSE 'deadline:warn:' || task_id || ':' || CAST(CAST(floor(remaining_s / 300) AS BIGINT) AS VARCHAR) END AS idempotency_key
  FROM k WHERE kind IS NOT NULL""")
def deadline_alerts(spark, sf_dir):
    log = event_log(spark, sf_dir)
    tasks = log.groupBy("task_id").agg(
        F.coalesce(folds.last(P + "to", is_type("task.state_changed")), F.lit("todo")).alias("status"),
        (F.min("created_at_ts") + F.lit(29.5 * 24 * HOUR)).alias("deadline_ts"),
    )
    return monitors.deadline_alerts(tasks, AS_OF, 12 * HOUR).drop("remaining_s")


@query(f"""{LOG}, s AS (SELECT task_id, arg_max(to_state, log_seq) FILTER (WHERE {_STATE}) AS status, arg_max(agent, log_seq) FILTER (WHERE {_OWNER}) AS owner,
  max(at_us) FILTER (WHERE event_type IN ('agent.heartbeat', 'task.state_changed')) / 1e6 AS last_act FROM log GROUP BY task_id)
  SELECT task_id, owner, last_act FROM s WHERE status = 'in_progress' AND {AS_OF} - last_act >= {24 * HOUR} AND coalesce(owner NOT IN ('agent0', 'agent1', 'agent2'), true)""")
def stall_detector(spark, sf_dir):
    registry = spark.createDataFrame([(f"agent{i}", "builtin" if i < 3 else "external") for i in range(7)], "name string, executor string")
    return monitors.stalled(event_log(spark, sf_dir), registry, AS_OF, 24 * HOUR)


@query(f"""{LOG}, e AS (SELECT concat_ws(':', task_id, CASE WHEN event_type LIKE 'task%' THEN 't' ELSE 'a' END, CAST(k AS VARCHAR)) AS idempotency_key, log_seq, event_type FROM log)
  SELECT idempotency_key, min(log_seq) AS log_seq, count(*) AS n, count(DISTINCT event_type) > 1 AS conflict FROM e GROUP BY idempotency_key""")
def idempotency_conflicts(spark, sf_dir):
    group = F.when(F.col("event_type").startswith("task"), "t").otherwise("a")
    k = F.element_at(F.split("idempotency_key", ":"), -1)
    log = event_log(spark, sf_dir).withColumn("idempotency_key", F.concat_ws(":", "task_id", group, k))
    return monitors.idempotency(log, ["event_type"])


@query(f"""{LOG} SELECT task_id, 'fixture' AS actor, CAST(floor(at_us / 1e6 / 60) AS BIGINT) AS minute, min(log_seq) AS log_seq, count(*) AS beats
  FROM log WHERE event_type = 'agent.heartbeat' GROUP BY ALL""")
def minute_dedupe(spark, sf_dir):
    return monitors.minute_dedupe(event_log(spark, sf_dir))


def _approvals(spark, sf_dir):
    """Conversations read as approvals: the first turn asks, users' turns sign, the signer is the turn modulo 3."""
    turn = F.col("turn")
    kind = F.when(turn == 0, "approval.requested").otherwise("approval.signed")
    given = {
        "approval_id": F.col("conv_id"),
        "signers": F.when(turn == 0, F.array(F.lit("s0"), F.lit("s1"), F.lit("s2"))),
        "rule": F.when((turn == 0) & (F.col("conv_id") % 2 == 0), "any"),
        "signer": F.when(turn > 0, F.concat(F.lit("s"), (turn % 4).cast("string"))),
        "result": F.when(turn > 0, F.when((F.length("text") + turn) % 3 == 0, "reject").otherwise("approve")),
        "scope": F.col("role"),
    }
    payload = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAYLOAD])
    own = {"log_seq": F.col("conv_id") * 1000 + turn, "event_type": kind, "created_at_ts": turn, "payload": payload}
    return table(spark, sf_dir, "conversations").select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT])


_VOTES = """WITH a AS (SELECT conv_id, turn, 's' || CAST(turn % 4 AS VARCHAR) AS signer, CASE WHEN (length(text) + turn) % 3 = 0 THEN 'reject' ELSE 'approve' END AS result FROM conversations),
  asked AS (SELECT DISTINCT conv_id FROM a WHERE turn = 0),
  by_signer AS (SELECT conv_id, signer, arg_max(result, turn) AS result FROM a JOIN asked USING (conv_id) WHERE turn > 0 AND signer IN ('s0', 's1', 's2') GROUP BY ALL),
  s AS (SELECT conv_id, count(signer) AS signed, count(*) FILTER (WHERE result = 'approve') AS approved, count(*) FILTER (WHERE result = 'reject') AS rejected
    FROM asked LEFT JOIN by_signer USING (conv_id) GROUP BY conv_id)"""


@query(f"{_VOTES} SELECT CAST(conv_id AS VARCHAR) AS approval_id, CAST(3 AS INT) AS total, CAST(signed AS INT) AS signed, CAST(approved AS INT) AS approved, CAST(rejected AS INT) AS rejected, CAST(3 - signed AS INT) AS n_pending FROM s")
def approval_fold(spark, sf_dir):
    return ap.progress(ap.approvals(_approvals(spark, sf_dir))).withColumn("n_pending", F.size("pending")).drop("pending")


@query(f"""{_VOTES} SELECT CAST(conv_id AS VARCHAR) AS approval_id, CASE WHEN conv_id % 2 = 0 THEN CASE WHEN approved > 0 THEN 'approve' WHEN signed = 3 THEN 'reject' END
  ELSE CASE WHEN rejected > 0 THEN 'reject' WHEN approved = 3 THEN 'approve' END END AS outcome FROM s""")
def countersign_eval(spark, sf_dir):
    return ap.outcome(ap.approvals(_approvals(spark, sf_dir)))


@query(f"""{_VOTES} SELECT CAST(conv_id AS VARCHAR) AS approval_id, o.result AS own_vote FROM s LEFT JOIN (SELECT conv_id, result FROM by_signer WHERE signer = 's1') o USING (conv_id) WHERE signed < 3""")
def pending_countersigns(spark, sf_dir):
    return ap.pending_for(ap.approvals(_approvals(spark, sf_dir)), "s1").select("approval_id", "own_vote")


@query(f"""{LOG} SELECT CAST(floor(at_us / 3600e6) AS BIGINT) AS hour, event_type, count(*) AS n, count(DISTINCT task_id) AS n_tasks FROM log GROUP BY ALL""")
def events_windowed(spark, sf_dir):
    hour = F.floor(F.col("created_at_ts") / 3600).alias("hour")
    return event_log(spark, sf_dir).groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("n_tasks"))
