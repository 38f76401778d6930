"""The event log as a stream: idempotent ingest, incremental read models and windows with late data.

One query writes; Spark's checkpoint takes the place of leases. A micro-batch that is replayed
after a failure gives the same result, as every sink here is keyed by the batch or by the events.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import EVENT
from ..operators.folds import P
from .readmodels import ReadModel

#: State of keys needs a store that holds one value for each, outside the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What an honest repetition of an event has in common with it.
CONTENT = ["event_type", "actor", "project_id", "task_id", "user_id", "payload"]


def read_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A growing folder of JSON lines as a stream of events; lines that cannot be parsed are skipped."""
    source = spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED")
    return (source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source).json(path).where("event_type IS NOT NULL")


def append_new(batch: DataFrame, log: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(to append, conflicts) of a batch against what is in the log.

    An event whose key is new is appended once, the first by log_seq. One whose key is there with
    the same content is nothing new; with other content it is a conflict. Events without a key are
    always appended.
    """
    known = log.where("idempotency_key IS NOT NULL").select("idempotency_key", _hash(content).alias("old"))
    hashed = batch.withColumn("hash", _hash(content))
    keyed = hashed.where("idempotency_key IS NOT NULL")
    # Combined before the shuffle: a key that is sent very often costs one row a task.
    first = keyed.groupBy("idempotency_key").agg(F.min_by(F.struct(*[F.col(c) for c in hashed.columns]), "log_seq").alias("r"))
    first = first.select("r.*")
    new = first.join(known.select("idempotency_key"), "idempotency_key", "left_anti")
    kept = known.select("idempotency_key", "old").unionByName(new.select("idempotency_key", F.col("hash").alias("old")))
    conflicts = keyed.join(kept, "idempotency_key").where("hash <> old").select(*batch.columns)
    return new.select(*batch.columns).unionByName(batch.where("idempotency_key IS NULL")), conflicts


def _hash(content: list[str]):
    return F.sha2(F.to_json(F.struct(*content)), 256)


class _Keys(StatefulProcessor):
    """For each idempotency key the hash and number of the first event that has it."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "hash string, log_seq long", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = self.first.get() if self.first.exists() else None
        held = list(rows) if first is None else rows
        if first is None:
            # The first by log_seq, whatever the order of arrival; all others are held against it.
            where = min(held, key=lambda x: x["log_seq"].min())
            own = where.loc[where["log_seq"].idxmin()]
            first = (own["hash"], int(own["log_seq"]))
            self.first.update(first)
        for frame in held:
            new, same = frame["log_seq"] == first[1], frame["hash"] == first[0]
            frame["outcome"] = np.where(new & same, "new", np.where(same, "repeated", "conflict"))
            yield frame[["event", "outcome"]]

    def close(self) -> None:
        pass


def judged(stream: DataFrame, content: list[str] | None = None, keep: timedelta | None = None) -> DataFrame:
    """The stream's events with ``outcome``: new, repeated or conflict.

    What has been seen of a key is kept in Spark's state store, and nothing of the log is read. It is
    kept for good, or for ``keep``: a key that comes again later counts as new. Within a batch the first by log_seq is the new one. An event without a
    key is always new; such events take no part in the state.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    columns = F.struct(*[F.col(c) for c in stream.columns])
    keyed = stream.where("idempotency_key IS NOT NULL").select("idempotency_key", "log_seq", _hash(content or CONTENT).alias("hash"), F.to_json(columns).alias("event"))
    processor = _Keys(None if keep is None else int(keep.total_seconds() * 1000))
    told = keyed.groupBy("idempotency_key").transformWithStateInPandas(processor, "event string, outcome string", "append", "None" if keep is None else "ProcessingTime")
    back = told.select(F.from_json("event", stream.schema).alias("e"), "outcome").select("e.*", "outcome")
    return back.unionByName(stream.where("idempotency_key IS NULL").withColumn("outcome", F.lit("new")))


def ingest(
    stream: DataFrame, log_path: str, conflict_path: str, checkpoint: str, content: list[str] | None = None, models: Sequence[ReadModel] = (), keep: timedelta | None = None
) -> StreamingQuery:
    """Append new events to a Parquet log and conflicting ones to another, and keep read models up to date; all are written by batch.

    A batch's folders are overwritten if it comes again, so a restart neither loses nor doubles
    events, and the state store goes back to where the batch began. A batch reads itself and the
    state of its own keys. The query ends when all that is there has been read; with ``keep``, whose
    clock runs on, it goes on until it is stopped.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            new = batch.where("outcome = 'new'").drop("outcome")
            new.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
            batch.where("outcome = 'conflict'").drop("outcome").write.mode("overwrite").parquet(f"{conflict_path}/batch={number}")
            for model in models:
                model.add(new, number)
        finally:
            batch.unpersist()

    writer = judged(stream, content, keep).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if keep is None else writer.trigger(processingTime="10 seconds")).start()


def windowed_counts(stream: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in windows of event time; what comes later than ``late`` no longer counts."""
    timed = stream.withColumn("at", F.timestamp_seconds("created_at_ts")).withWatermark("at", late)
    rows = timed.groupBy(F.window("at", length).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


def heartbeats(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first heartbeat of each task, actor and minute; state is kept for as long as events may be late."""
    minute = F.floor(F.col("created_at_ts") / 60)
    beats = stream.where(F.col("event_type") == "agent.heartbeat").withColumn("at", F.timestamp_seconds("created_at_ts")).withColumn("minute", minute)
    return beats.withWatermark("at", late).dropDuplicatesWithinWatermark(["task_id", "actor", "minute"])


def state_changes(stream: DataFrame) -> DataFrame:
    """(task_id, log_seq, to, created_at_ts) of all state changes, as a stream."""
    rows = stream.where(F.col("event_type") == "task.state_changed")
    return rows.select("task_id", "log_seq", F.col(P + "to").alias("to"), "created_at_ts")
