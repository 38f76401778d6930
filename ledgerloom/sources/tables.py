"""The fixture tables, and the event log that is read out of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: ``events`` as a log, in SQL that Spark and DuckDB share but for two functions. A user is a task;
#: views stand for the smaller event types, dealt by k.
_LOG = """
SELECT event_id AS log_seq, CAST(user_id AS {text}) AS task_id, CAST(user_id % 5 AS {text}) AS project_id, k, value,
  {micros} AS at_us,
  CASE event_type WHEN 'signup' THEN 'task.created' WHEN 'view' THEN
    CASE k % 6 WHEN 1 THEN 'agent.assigned' WHEN 2 THEN 'deliverable.submitted' WHEN 3 THEN 'review.requested'
      WHEN 4 THEN 'review.decided' WHEN 5 THEN 'feedback.submitted' ELSE 'agent.heartbeat' END
    ELSE 'task.state_changed' END AS event_type,
  CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'completed' END AS to_state,
  concat('agent', CAST(k % 7 AS {text})) AS agent, CASE WHEN k % 2 = 0 THEN 'owner' ELSE 'reviewer' END AS role,
  concat(CAST(user_id AS {text}), '-', CAST(k {div} 12 AS {text})) AS review_id,
  CASE WHEN k % 5 = 0 THEN 'reject' WHEN k % 5 = 1 THEN 'needs_changes' ELSE 'pass' END AS verdict,
  concat('f', CAST(k AS {text}), '.md') AS file_ref,
  concat('Task ', CAST(user_id AS {text}), ' v', CAST(k AS {text})) AS title
FROM (SELECT *, CAST({json} AS INT) AS k FROM {source})
"""

LOG_SQL = _LOG.format(text="VARCHAR", micros="epoch_us(ts)", div="//", json="json_extract_string(props, '$.k')", source="events")


def flat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with one column for each payload key that the fixture has; the twin of LOG_SQL."""
    events = table(spark, sf_dir, "events")
    sql = _LOG.format(
        text="STRING", micros="timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", div="DIV", json="get_json_object(props, '$.k')", source="{events}"
    )
    return spark.sql(sql, events=events)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the envelope of ``model.EVENT``."""
    from ..model import PAYLOAD

    flat = flat_log(spark, sf_dir)
    of = lambda kinds, col: F.when(F.col("event_type").isin(kinds), col)
    given = {
        "title": of(["task.created"], F.col("title")),
        "to": F.col("to_state"),
        "agent": of(["agent.assigned"], F.col("agent")),
        "role": of(["agent.assigned"], F.col("role")),
        "file_ref": of(["deliverable.submitted"], F.col("file_ref")),
        "review_id": of(["review.requested", "review.decided"], F.col("review_id")),
        "verdict": of(["review.decided"], F.col("verdict")),
        "content": of(["feedback.submitted"], F.col("file_ref")),
    }
    payload = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAYLOAD])
    return flat.select(
        "log_seq", "event_type", F.lit("fixture").alias("actor"), "project_id", "task_id", F.col("project_id").alias("user_id"),
        F.concat_ws(":", "task_id", "event_type", "k").alias("idempotency_key"), (F.col("at_us") / 1e6).alias("created_at_ts"), payload.alias("payload"),
    )
