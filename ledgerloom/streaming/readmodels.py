"""Read models that follow a log batch by batch, without reading the log again.

A model is a folder of partial folds: one for each batch, written as a whole, and now and then a base
that holds all up to a batch. A batch costs what it brings. A reader takes the newest finished base
and the batches after it. A batch that comes again overwrites its own folder with the same; what
has no mark of success is not read. Bases and batches that a newer base covers are removed once two
newer ones are there, so a reader that has begun keeps its files.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import folds, merging
from ..operators.folds import P, is_type
from ..operators.merging import Field

#: A base is written after so many batches.
EVERY = 32


@dataclass(frozen=True)
class ReadModel:
    """A mergeable fold by ``key`` below ``path``; ``shape`` makes the model's rows of the fold's values."""

    path: str
    key: str
    fields: dict[str, Field] = field(hash=False)
    shape: Callable[[DataFrame], DataFrame] = lambda df: df
    every: int = EVERY

    def _finished(self, spark: SparkSession) -> dict[str, list[int]]:
        """Numbers of the bases and batches that are there in full, in order."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"base": [], "batch": []}
        if files.exists(where):
            for status in files.listStatus(where):
                m = re.fullmatch(r"(base|batch)-(\d+)", status.getPath().getName())
                if m and files.exists(status.getPath().suffix("/_SUCCESS")):
                    found[m[1]].append(int(m[2]))
        return {k: sorted(v) for k, v in found.items()}

    def _parts(self, spark: SparkSession, upto: int | None = None) -> list[str]:
        """Folders that make up the model, or its state after batch ``upto``."""
        there = self._finished(spark)
        bases = [n for n in there["base"] if upto is None or n <= upto]
        last = bases[-1] if bases else -1
        batches = [n for n in there["batch"] if n > last and (upto is None or n <= upto)]
        return [f"{self.path}/base-{last}"] * bool(bases) + [f"{self.path}/batch-{n}" for n in batches]

    def add(self, batch: DataFrame, number: int) -> None:
        """Fold one batch of new events."""
        merging.fold_part(batch, self.key, self.fields).write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        if (number + 1) % self.every == 0:
            self.rebase(batch.sparkSession, number)

    def rebase(self, spark: SparkSession, number: int) -> None:
        """Write a base of all up to a batch, and remove what only bases before the last two need."""
        parts = [p for p in self._parts(spark, number) if not p.endswith(f"/base-{number}")]
        if not parts:
            return
        merging.merge_parts(spark.read.parquet(*parts), self.key, self.fields).write.mode("overwrite").parquet(f"{self.path}/base-{number}")
        there = self._finished(spark)
        for kind, numbers in there.items():
            for n in numbers:
                if len(there["base"]) > 2 and (n < there["base"][-2] if kind == "base" else n <= there["base"][-2]):
                    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{n}")
                    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The model as it is now; None before its first batch."""
        parts = self._parts(spark)
        if not parts:
            return None
        merged = merging.merge_parts(spark.read.parquet(*parts), self.key, self.fields)
        return self.shape(merging.values_of(merged, self.key, self.fields))


def task_board(path: str, every: int = EVERY) -> ReadModel:
    """``folds.task_board``, kept up to date."""
    made, assigned, moved = (lambda: is_type("task.created")), (lambda: is_type("agent.assigned")), (lambda: is_type("task.state_changed"))
    owns = lambda: F.coalesce(P + "role", F.lit("owner")) == "owner"
    column = lambda c: (lambda: F.col(c))
    fields = {
        "made": merging.count_of(made),
        "project_id": merging.last_of(column("project_id"), made),
        "title": merging.last_of(column(P + "title"), made),
        "owner": merging.last_of(column(P + "agent"), lambda: assigned() & owns()),
        "reviewer": merging.last_of(column(P + "agent"), lambda: assigned() & ~owns()),
        "status": merging.last_of(column(P + "to"), moved),
        "has_deliverable": merging.any_of(lambda: is_type("deliverable.submitted")),
        "version": merging.count_of(moved),
    }
    shape = lambda df: df.where("made > 0").drop("made").withColumn("status", F.coalesce("status", F.lit("todo")))
    return ReadModel(path, "task_id", fields, shape, every)


def agent_registry(path: str, every: int = EVERY) -> ReadModel:
    """``folds.agent_registry``, kept up to date; the log has the agent's name in its payload."""
    column = lambda c: (lambda: F.col(P + c))
    fields = {c: merging.last_of(column(c)) for c in ("capability", "role")}
    fields["status"] = merging.last_of(lambda: F.coalesce(P + "status", F.lit("available")))
    fields["executor"] = merging.last_of(lambda: F.coalesce(P + "executor", F.lit("builtin")))
    return ReadModel(path, "name", fields, every=every)


def refresh(stream: DataFrame, model: ReadModel, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Keep a model up to date from a stream of events; ``prepare`` is applied to each batch before."""
    return stream.writeStream.foreachBatch(lambda batch, number: model.add(prepare(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def registrations(log: DataFrame) -> DataFrame:
    """The events that ``agent_registry`` folds, with the agent's name beside them."""
    return log.where(is_type("agent.registered")).withColumn("name", F.col(folds.P + "name"))
