"""Who does a task: by name, by capability, else the first builtin agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import matching

#: The level that each action needs, that of any other, and the levels that need an approval as well.
NEEDS = {
    "read_project": 0, "read_audit": 0, "write_message": 1, "change_task_state": 1, "submit_deliverable": 1, "send_handover": 2,
    "modify_chain": 3, "approve_action": 3, "pause_project": 3, "external_irreversible": 4,
}
DEFAULT_NEED, APPROVED_FROM, APPROVAL = 1, 3, "approve_action"


def available(agents: DataFrame) -> DataFrame:
    """Agents that are not disabled; those of a registry without a status all are."""
    return agents.where(F.coalesce("status", F.lit("available")) != "disabled").drop("status") if "status" in agents.columns else agents


def _words(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 1))


def _able(asked: DataFrame, agents: DataFrame, score: Column) -> DataFrame:
    """(word, a): the best agent for each word of ``asked(word)`` that is part of a capability.

    A word has no space, so it is part of one word of a capability. Equal words of capabilities are
    reduced to their best agent first; parts are listed by hash, and only in lengths that titles have.
    """
    best = F.struct(score.alias("score"), "pos", "name").alias("best")
    able = agents.select(best, F.explode(_words("capability")).alias("word")).groupBy("word").agg(F.min("best").alias("best"))
    wanted = matching.whole_words(asked.select("word").distinct())
    # Different lengths of words: a few numbers.
    lengths = sorted(r[0] for r in asked.select(F.length("word").alias("n")).distinct().collect())
    parts = matching.parts_of_words(able, lengths)
    return wanted.join(parts, ["n", "h1", "h2"]).select("word", F.col("best").alias("a"))


def match_owner(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """(task_id, owner) for tasks (task_id, title, hint) from agents (pos, name, capability, executor, perhaps status).

    Builtin agents come first, by hint and then by a title word that is in their capability;
    external ones next, likewise; then the first builtin agent. Disabled agents do nothing. Ties go
    to the smaller position. A task for which there is nobody has a null owner.
    """
    agents = available(agents)
    outside = F.when(F.col("executor") == "builtin", 0).otherwise(2)
    named = agents.select(F.lower("name").alias("word"), "name", "pos", outside.alias("score"))
    hints = tasks.where("hint <> ''").select("task_id", F.lower(F.trim("hint")).alias("word"))
    asked = tasks.select("task_id", F.explode(_words("title")).alias("word"))
    # Equal words are reduced to their best agent before any task meets them.
    best = lambda df: df.groupBy("word").agg(F.min(F.struct("score", "pos", "name")).alias("a"))
    able = _able(asked, agents, outside + 1)
    hits = hints.join(best(named), "word").select("task_id", "a").union(asked.join(able, "word").select("task_id", "a"))
    found = hits.groupBy("task_id").agg(F.min("a").alias("a"))
    default = agents.where("executor = 'builtin'").agg(F.min_by("name", "pos").alias("fallback"))
    rows = tasks.select("task_id").join(found, "task_id", "left").crossJoin(F.broadcast(default))  # one row
    return rows.select("task_id", F.coalesce("a.name", "fallback").alias("owner"))


def match_reviewer(owners: DataFrame, agents: DataFrame) -> DataFrame:
    """(task_id, owner, reviewer): the agent that a hint names, else the first, but never the owner.

    ``owners`` may have ``reviewer_hint``. The first two agents are enough to know the first other one.
    """
    agents = available(agents)
    two = agents.orderBy("pos").limit(2).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("c"))
    other = F.get(F.filter("c", lambda x: ~x["name"].eqNullSafe(F.col("owner"))), F.lit(0))["name"]
    if "reviewer_hint" not in owners.columns:
        owners = owners.withColumn("reviewer_hint", F.lit(None).cast("string"))
    named = agents.groupBy(F.lower("name").alias("word")).agg(F.min_by("name", "pos").alias("hinted"))
    rows = owners.withColumn("word", F.lower(F.trim("reviewer_hint"))).join(named, "word", "left").crossJoin(F.broadcast(two))  # one row
    hinted = F.when(~F.col("hinted").eqNullSafe(F.col("owner")), F.col("hinted"))
    return rows.select("task_id", "owner", F.coalesce(hinted, other).alias("reviewer"))


def permissions(requests: DataFrame) -> DataFrame:
    """``requests(level, action ...)`` with ``needed`` and ``outcome``: denied, approval or allowed.

    A missing level is the lowest but one, as is the need of an unknown action. Approving is no
    action that needs an approval.
    """
    needs = F.create_map(*[F.lit(x) for pair in NEEDS.items() for x in pair])
    needed = F.coalesce(F.try_element_at(needs, "action"), F.lit(DEFAULT_NEED))
    short = F.coalesce("level", F.lit(DEFAULT_NEED)) < needed
    gate = (needed >= APPROVED_FROM) & ~F.col("action").eqNullSafe(F.lit(APPROVAL))
    return requests.withColumn("needed", needed).withColumn("outcome", F.when(short, "denied").when(gate, "approval").otherwise("allowed"))


def unregistered(templates: DataFrame, registry: DataFrame) -> DataFrame:
    """Templates of agents that no registered agent has been made of."""
    return templates.join(registry.select("name"), "name", "left_anti")
