"""Queries that join and compare tables: dependencies, registries, teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitors, teams
from ..sources.tables import LOG_SQL, event_log, table
from .catalog import query


def _deps(spark, sf_dir):
    """Each order as a task that depends on the orders at half and a third of its number, and 'completed' if finished."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("todo")
    deps = F.array((k / 2).cast("long"), (k / 3).cast("long")).cast("array<string>")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("task_id"), status.alias("status"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(deps).alias("depends_on"))
    return rows


@query("""WITH t AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'todo' END AS status FROM orders),
  d AS (SELECT k, unnest([k // 2, k // 3]) AS dep FROM t WHERE k % 5 <> 0),
  r AS (SELECT d.k, bool_and(coalesce(u.status = 'completed', false)) AS ready, count(*) AS n FROM d LEFT JOIN t u ON d.dep = u.k GROUP BY d.k)
  SELECT CAST(t.k AS VARCHAR) AS task_id, coalesce(ready, true) AS ready, coalesce(n, 0) AS n_deps FROM t LEFT JOIN r ON t.k = r.k""")
def deps_ready(spark, sf_dir):
    rows = _deps(spark, sf_dir)
    return monitors.deps_ready(rows.select("task_id", "depends_on"), rows.select("task_id", "status"))


@query(f"""WITH log AS ({LOG_SQL}), latest AS (SELECT task_id, arg_max(file_ref, log_seq) AS file_ref, max(log_seq) AS last_seq FROM log WHERE event_type = 'deliverable.submitted' GROUP BY task_id),
  d AS (SELECT DISTINCT user_id AS k, unnest([user_id // 2, user_id // 3]) AS dep FROM (SELECT DISTINCT user_id FROM events))
  SELECT CAST(k AS VARCHAR) AS task_id, CAST(dep AS VARCHAR) AS dep, file_ref, last_seq FROM d JOIN latest ON CAST(dep AS VARCHAR) = latest.task_id""")
def upstream_latest(spark, sf_dir):
    log = event_log(spark, sf_dir)
    user = F.col("user_id")
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    tasks = ids.select(user.cast("string").alias("task_id"), F.array_distinct(F.array((user / 2).cast("long"), (user / 3).cast("long"))).cast("array<string>").alias("depends_on"))
    return monitors.upstream_deliverables(tasks, log)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'")
def token_user_join(spark, sf_dir):
    tokens = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return tokens.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@query("""SELECT c_custkey, c_name AS name FROM customer WHERE c_name NOT IN
  (SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') FROM orders WHERE o_orderstatus = 'P')""")
def registry_anti(spark, sf_dir):
    """Customers as templates of agents, of which those with a partly finished order have been registered."""
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    registry = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(name.alias("name"))
    return teams.unregistered(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_custkey"), registry).select("c_custkey", "name")


@query("""WITH a AS (SELECT s_suppkey AS pos, s_name AS name, n_name AS capability, CASE WHEN s_suppkey % 3 = 0 THEN 'external' ELSE 'builtin' END AS executor
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  t AS (SELECT c_custkey AS task_id, n_name AS title, CASE WHEN c_custkey % 4 = 0 THEN upper('Supplier#' || CAST(c_custkey % 7 AS VARCHAR)) ELSE '' END AS hint
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
  m AS (SELECT task_id, name, CASE WHEN lower(name) = lower(hint) THEN 0 WHEN length(title) > 1 AND contains(lower(capability), lower(title)) THEN 1 WHEN executor = 'builtin' THEN 4 ELSE 9 END
      + CASE WHEN executor = 'builtin' THEN 0 ELSE 2 END AS score, pos FROM t, a),
  b AS (SELECT task_id, name AS owner, score, row_number() OVER (PARTITION BY task_id ORDER BY score, pos) AS r FROM m WHERE score < 9)
  SELECT task_id, owner FROM b WHERE r = 1""")
def team_match(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    agents = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), F.col("n_name").alias("capability"), F.when(F.col("s_suppkey") % 3 == 0, "external").otherwise("builtin").alias("executor")
    )
    hint = F.when(F.col("c_custkey") % 4 == 0, F.upper(F.concat(F.lit("Supplier#"), (F.col("c_custkey") % 7).cast("string")))).otherwise("")
    tasks = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("task_id"), F.col("n_name").alias("title"), hint.alias("hint"))
    return teams.match_owner(tasks, agents)
