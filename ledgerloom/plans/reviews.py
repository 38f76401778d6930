"""Queries of reviews, versions, transfers and titles over the event log and its neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as cat
from ..operators import folds, monitors, review
from ..operators.folds import P, is_type
from ..sources.tables import LOG_SQL, event_log, table
from .catalog import query
from .events import _approvals

#: The log with blocked tasks read as tasks in review.
LOG = f"WITH log AS (SELECT * REPLACE (CASE to_state WHEN 'blocked' THEN 'in_review' ELSE to_state END AS to_state) FROM ({LOG_SQL}))"
_STATE = "event_type = 'task.state_changed'"


def _log(spark, sf_dir):
    to = F.when(F.col(P + "to") == "blocked", "in_review").otherwise(F.col(P + "to"))
    return event_log(spark, sf_dir).withColumn("payload", F.col("payload").withField("to", to))


_STATES = f"""s AS (SELECT task_id, coalesce(arg_max(to_state, log_seq) FILTER (WHERE {_STATE}), 'todo') AS status, coalesce(arg_max(title, log_seq) FILTER (WHERE event_type = 'task.created'), '') AS title,
    arg_max(file_ref, log_seq) FILTER (WHERE event_type = 'deliverable.submitted') AS latest, arg_max(review_id, log_seq) FILTER (WHERE event_type = 'review.requested') AS review_id,
    arg_max(agent, log_seq) FILTER (WHERE event_type = 'agent.assigned' AND role = 'reviewer') AS reviewer FROM log GROUP BY task_id)"""


@query(f"""{LOG}, {_STATES} SELECT task_id, review_id, CASE WHEN latest IS NOT NULL THEN 'pass' ELSE 'needs_changes' END AS verdict, CASE WHEN latest IS NOT NULL THEN 'completed' ELSE 'in_progress' END AS next_state
  FROM s WHERE status = 'in_review' AND review_id IS NOT NULL AND review_id NOT IN (SELECT review_id FROM log WHERE event_type = 'review.decided')
    AND (reviewer IS NULL OR reviewer IN ('agent0', 'agent1', 'agent2', 'agent3'))""")
def auto_review(spark, sf_dir):
    log = _log(spark, sf_dir)
    extra = log.limit(1).select(
        *[
            F.explode(F.array(*[F.lit(f"agent{i}") for i in range(4)])).alias("n") if c == "log_seq" else F.lit("agent.registered").alias(c) if c == "event_type" else F.col(c)
            for c in log.columns
        ]
    )
    registered = extra.withColumn("payload", F.col("payload").withField("name", F.col("n"))).withColumn("log_seq", F.lit(0).cast("bigint")).withColumn("task_id", F.lit(None).cast("string"))
    return review.auto_review(log.unionByName(registered.select(log.columns))).drop("idempotency_key")


_ANSWERS = """a AS (SELECT task_id, file_ref, CASE length(file_ref) % 2 WHEN 0 THEN 'PASS' ELSE 'CHECK' END AS verdict FROM s JOIN (SELECT DISTINCT task_id AS t, file_ref FROM log WHERE event_type = 'deliverable.submitted') ON t = task_id AND file_ref = latest)"""


@query(f"""{LOG}, {_STATES}, {_ANSWERS} SELECT task_id, CASE WHEN title NOT LIKE '%1' THEN 'SKIP' WHEN latest IS NULL THEN 'NA' ELSE a.verdict END AS verdict, title LIKE '%1' AND latest IS NOT NULL AS checked
  FROM s LEFT JOIN a USING (task_id) WHERE title <> ''""")
def numeric_rechecks(spark, sf_dir):
    title = F.col(P + "title")
    log = _log(spark, sf_dir).withColumn("payload", F.col("payload").withField("title", F.when(title.endswith("1"), F.concat(title, F.lit("汇总"))).otherwise(title)))
    sent = log.where(is_type("deliverable.submitted")).select("task_id", F.col(P + "file_ref").alias("file_ref")).distinct()
    answer = F.when(F.length("file_ref") % 2 == 0, 'x {"verdict": "PASS", "note": "n"}').otherwise("no verdict")
    return review.recheck(log, sent.withColumn("answer", answer)).select("task_id", "verdict", "checked")


@query(f"""WITH RECURSIVE log AS ({LOG_SQL}), m AS (SELECT task_id, log_seq, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN k % 5 ELSE 1 END AS expected_version, row_number() OVER (PARTITION BY task_id ORDER BY log_seq) AS r FROM log WHERE {_STATE}),
  w AS (SELECT task_id, log_seq, expected_version, r, 0 AS version, expected_version IS NULL OR expected_version = 0 AS ok FROM m WHERE r = 1
    UNION ALL SELECT m.task_id, m.log_seq, m.expected_version, m.r, w.version + CAST(w.ok AS INT), m.expected_version IS NULL OR m.expected_version = w.version + CAST(w.ok AS INT) FROM w JOIN m ON m.task_id = w.task_id AND m.r = w.r + 1)
  SELECT task_id, log_seq, CAST(expected_version AS BIGINT) AS expected_version, CAST(version AS BIGINT) AS version FROM w WHERE NOT ok""")
def stale_versions(spark, sf_dir):
    k = F.element_at(F.split("idempotency_key", ":"), -1).cast("int")
    expected = F.when(k % 3 == 1, k % 5).when(k % 3 == 2, 1)
    log = event_log(spark, sf_dir).where(is_type("task.state_changed"))
    return review.stale_versions(log.select("task_id", "log_seq", F.col(P + "to").alias("to"), expected.cast("bigint").alias("expected_version")))


@query(f"WITH log AS ({LOG_SQL}) SELECT log_seq, CASE WHEN log_seq % 50 = 0 THEN 'deleted' ELSE 'updated' END AS change FROM log WHERE log_seq % 50 = 0 OR (log_seq % 70 = 0 AND event_type = 'task.state_changed')")
def append_only_audit(spark, sf_dir):
    before = event_log(spark, sf_dir).drop("payload")
    kind = F.when(F.col("log_seq") % 70 == 0, F.when(is_type("task.state_changed"), "task.blocked").otherwise(F.col("event_type"))).otherwise(F.col("event_type"))
    return review.append_only(before, before.where("log_seq % 50 <> 0").withColumn("event_type", kind))


@query(f"WITH log AS ({LOG_SQL}) SELECT task_id, arg_max(agent, log_seq) AS agent, max(log_seq) AS log_seq FROM log WHERE event_type = 'agent.assigned' GROUP BY task_id")
def last_transfers(spark, sf_dir):
    log = event_log(spark, sf_dir)
    moved = F.when(is_type("agent.assigned"), "agent.transferred").otherwise(F.col("event_type"))
    return review.last_transfer(log.withColumn("event_type", moved))


@query(f"WITH log AS ({LOG_SQL}) SELECT min(log_seq) AS log_seq FROM log WHERE concat_ws(':', task_id, event_type, CAST(k AS VARCHAR)) = (SELECT arg_max(concat_ws(':', task_id, event_type, CAST(k AS VARCHAR)), log_seq) FROM log)")
def key_lookup(spark, sf_dir):
    log = event_log(spark, sf_dir)
    key = log.agg(F.max_by("idempotency_key", "log_seq")).first()[0]
    return review.find_key(log, key).select("log_seq")


@query("""WITH a AS (SELECT CAST(conv_id AS VARCHAR) AS approval_id, conv_id FROM conversations WHERE turn = 0 GROUP BY conv_id)
  SELECT approval_id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'P' || CAST(conv_id % 3 AS VARCHAR) END AS project_title, CASE WHEN conv_id % 4 = 1 THEN 'T1' ELSE '' END AS task_title FROM a""")
def pending_titles(spark, sf_dir):
    a = F.col(P + "approval_id").cast("bigint")
    asked = _approvals(spark, sf_dir).withColumn("project_id", (a % 3).cast("string")).withColumn("task_id", (a % 4).cast("string"))
    one = asked.limit(1).withColumn("log_seq", F.lit(0).cast("bigint"))
    title = lambda kind, p, t, text: one.withColumn("event_type", F.lit(kind)).withColumn("project_id", F.lit(p)).withColumn("task_id", F.lit(t)).withColumn("payload", F.col("payload").withField("title", F.lit(text)))
    log = asked.unionByName(title("project.created", "1", None, "P1")).unionByName(title("project.created", "2", None, "P2")).unionByName(title("task.created", "1", "1", "T1"))
    return review.pending_with_titles(log, "s1").drop("requested_ts")


@query("""WITH d AS (SELECT o_custkey AS batch, o_orderkey AS pos, 'i' || CAST(o_orderkey AS VARCHAR) AS id, 'T' || CAST(o_orderkey % 3 AS VARCHAR) AS title, 'T' || CAST((o_orderkey + 1) % 4 AS VARCHAR) AS d1 FROM orders),
  i AS (SELECT batch, title, arg_max(id, pos) AS dep FROM d GROUP BY batch, title)
  SELECT d.batch, d.pos, own.dep AS task_id, coalesce(i.dep, '') AS depends_on FROM d JOIN i own ON own.batch = d.batch AND own.title = d.title LEFT JOIN i ON i.batch = d.batch AND i.title = d.d1 AND i.dep <> own.dep""")
def titles_resolved(spark, sf_dir):
    key = F.col("o_orderkey")
    name = lambda n: F.concat(F.lit("T"), n.cast("string"))
    drafts = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("batch"), key.alias("pos"), F.concat(F.lit("i"), key.cast("string")).alias("task_id"), name(key % 3).alias("title"), F.array(name((key + 1) % 4), name(key % 3)).alias("depends_on")
    )
    return review.resolve_titles(drafts).withColumn("depends_on", F.array_join("depends_on", ","))


@query("SELECT doc_id, length(text) AS content_len, substring(sha256(text), 1, 16) AS content_hash, substring(text, 1, 500) AS preview, text IS NULL AS file_missing FROM documents")
def content_evidence(spark, sf_dir):
    found = review.evidence(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_ref"), F.col("text").alias("content")))
    return found.withColumnRenamed("file_ref", "doc_id")


@query(f"""WITH log AS ({LOG_SQL}), s AS (SELECT task_id, coalesce(arg_max(to_state, log_seq) FILTER (WHERE {_STATE}), 'todo') AS status FROM log GROUP BY task_id),
  t AS (SELECT task_id, status FROM s WHERE CAST(task_id AS BIGINT) % 2 = 0 AND status IN ('todo', 'in_progress'))
  SELECT task_id, 0 AS step, NULL AS to_state FROM t UNION ALL SELECT task_id, 1, 'in_progress' FROM t WHERE status = 'todo' UNION ALL SELECT task_id, 2, 'blocked' FROM t""")
def escalation_steps(spark, sf_dir):
    log = event_log(spark, sf_dir)
    states = log.groupBy("task_id").agg(F.coalesce(folds.last(P + "to", is_type("task.state_changed")), F.lit("todo")).alias("status"))
    late = states.where(F.col("task_id").cast("bigint") % 2 == 0).select("task_id", F.concat(F.lit("x"), "task_id").alias("transfer_id"))
    return monitors.transfer_escalations(late, states).select("task_id", "step", "to_state")


@query(f"""WITH log AS ({LOG_SQL}), s AS (SELECT task_id, coalesce(arg_max(to_state, log_seq) FILTER (WHERE {_STATE}), 'todo') AS status FROM log GROUP BY task_id),
  t AS (SELECT CAST(c_custkey AS VARCHAR) AS task_id, CAST(c_custkey - 1 AS VARCHAR) AS dep FROM customer)
  SELECT t.task_id, 'todo' AS from_state, 'in_progress' AS to_state FROM t LEFT JOIN s own USING (task_id) JOIN s d ON d.task_id = t.dep WHERE coalesce(own.status, 'todo') = 'todo' AND d.status = 'completed'""")
def auto_starts(spark, sf_dir):
    states = event_log(spark, sf_dir).groupBy("task_id").agg(F.coalesce(folds.last(P + "to", is_type("task.state_changed")), F.lit("todo")).alias("status"))
    key = F.col("c_custkey")
    tasks = table(spark, sf_dir, "customer").select(key.cast("string").alias("task_id"), F.array((key - 1).cast("string")).alias("depends_on"))
    return monitors.auto_starts(tasks, states)


@query("""WITH s AS (SELECT conv_id, turn, role, text, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM conversations),
  i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM s)
  SELECT conv_id, CAST(min(turn) AS BIGINT) AS pos, min(role) AS name, count(*) AS n FROM i GROUP BY conv_id, island HAVING sum(length(text)) >= 400""")
def sections_merged(spark, sf_dir):
    sections = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.col("role").alias("name"), F.array("text").alias("paragraphs"))
    return cat.merge_sections(sections).select(F.col("doc").alias("conv_id"), "pos", "name", F.size("paragraphs").cast("bigint").alias("n"))
