"""Countersigning: approvals folded from the log, their progress and their outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import P, is_type, kind, seq


def parse_signers(text: Column | str) -> Column:
    """A list of names between commas of either kind or enumeration marks; trimmed, no empty ones, each once."""
    parts = F.transform(F.split(text, "[,，、]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def approvals(log: DataFrame) -> DataFrame:
    """One row for each approval. A new request starts it anew; what came before no longer counts.

    signatures is an array of (signer, result, opinion, ts) in order; the rule is ``all`` if missing.
    """
    own = log.where(kind().startswith("approval.") & F.col(P + "approval_id").isNotNull()).withColumn("approval_id", F.col(P + "approval_id"))
    named = is_type("approval.requested", "approval.signers_set")
    signed = F.struct(seq().alias("s"), F.col(P + "signer").alias("signer"), F.col(P + "result").alias("result"), F.col(P + "opinion").alias("opinion"), F.col("created_at_ts").alias("ts"))
    # One pass: the last naming is never before the last request, and what is older than that is left out afterwards.
    asked = F.when(is_type("approval.requested"), seq())
    rows = own.groupBy("approval_id").agg(
        F.max(asked).alias("start"),
        F.max_by(F.struct("project_id", "task_id", P + "scope", P + "initiator", "created_at_ts"), asked).alias("r"),
        F.max_by(F.struct(P + "signers", P + "rule"), F.when(named, seq())).alias("n"),
        F.array_sort(F.collect_list(F.when(is_type("approval.signed"), signed))).alias("signatures"),
        F.max_by(F.struct(seq().alias("s"), F.col(P + "result").alias("result")), F.when(is_type("approval.decided"), seq())).alias("d"),
    )
    rows = rows.where("start IS NOT NULL").withColumn("signatures", F.filter("signatures", lambda x: x.s >= F.col("start")))
    rows = rows.withColumn("decision", F.when(F.col("d.s") >= F.col("start"), F.col("d.result")))
    return rows.select(
        "approval_id", "r.project_id", "r.task_id", "r.scope", "r.initiator", F.col("r.created_at_ts").alias("requested_ts"),
        F.array_distinct(F.coalesce("n.signers", F.array().cast("array<string>"))).alias("signers"),
        F.coalesce("n.rule", F.lit("all")).alias("rule"), "signatures", "decision",
    )


def votes(approvals: DataFrame) -> DataFrame:
    """``approvals`` with ``by``: the last result of each listed signer. Signatures of others do not count."""
    valid = F.filter("signatures", lambda s: F.array_contains(F.col("signers"), s.signer))
    # Sorted by signer and place, a signer's last is the one before another signer's first.
    ordered = F.array_sort(F.transform(valid, lambda s: F.struct(s.signer.alias("signer"), s.s.alias("s"), s.result.alias("result"))))
    last_only = F.filter(ordered, lambda s, i: ~F.coalesce(F.get(ordered, i + 1)["signer"] == s.signer, F.lit(False)))
    return approvals.withColumn("by", F.map_from_entries(F.transform(last_only, lambda s: F.struct(s.signer, s.result))))


def progress(approvals: DataFrame) -> DataFrame:
    rows = votes(approvals)
    n = lambda result: F.size(F.filter(F.map_values("by"), lambda r: r == result))
    return rows.select(
        "approval_id",
        F.size("signers").alias("total"),
        F.size(F.map_keys("by")).alias("signed"),
        n("approve").alias("approved"),
        n("reject").alias("rejected"),
        F.array_except("signers", F.map_keys("by")).alias("pending"),
    )


def outcome(approvals: DataFrame) -> DataFrame:
    """approve, reject or null. ``any``: the first approval decides, all signed without one rejects.
    ``all``: any rejection rejects, approval by all approves. Without signers nothing is decided."""
    rows = votes(approvals)
    n = lambda result: F.size(F.filter(F.map_values("by"), lambda r: r == result))
    everyone = F.size("signers")
    any_rule = F.when(n("approve") > 0, "approve").when(F.size(F.map_keys("by")) == everyone, "reject")
    all_rule = F.when(n("reject") > 0, "reject").when(n("approve") == everyone, "approve")
    return rows.select("approval_id", F.when(everyone == 0, None).when(F.col("rule") == "any", any_rule).otherwise(all_rule).alias("outcome"))


def pending_for(approvals: DataFrame, signer: str) -> DataFrame:
    """Undecided approvals that list ``signer``, with the own vote, newest request first."""
    rows = votes(approvals).where(F.col("decision").isNull() & F.array_contains("signers", signer))
    rows = rows.where(F.size(F.array_except("signers", F.map_keys("by"))) > 0)
    return rows.select("approval_id", "scope", "requested_ts", F.col("by")[signer].alias("own_vote")).orderBy(F.desc("requested_ts"), "approval_id")


def approved_for(approvals: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of (task_id, wanted_scope): whether some approval of the task, decided in favour, covers the scope."""
    good = approvals.where("decision = 'approve'").select("task_id", "scope")
    met = wanted.join(good, "task_id", "left")
    return met.groupBy("task_id", "wanted_scope").agg(F.bool_or(F.coalesce(F.contains("scope", "wanted_scope"), F.lit(False))).alias("approved"))
