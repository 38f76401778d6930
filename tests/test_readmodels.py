"""Ingest by keyed state and read models that are merged, against folds of the whole log."""

from __future__ import annotations

import json
import os
import random
import shutil

from pyspark.sql import functions as F

from ledgerloom.model import EVENT, events_frame
from ledgerloom.operators import folds, merging
from ledgerloom.streaming import ingest, readmodels

KINDS = ["task.created", "agent.assigned", "task.state_changed", "deliverable.submitted", "agent.heartbeat"]


def log_of(spark, n, seed):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        kind = rng.choice(KINDS)
        payload = {"title": f"T{rng.randrange(9)}"} if kind == "task.created" else {"agent": f"a{rng.randrange(4)}", "role": rng.choice(["owner", "reviewer", None])} if kind == "agent.assigned" else {}
        if kind == "task.state_changed":
            payload = {"to": rng.choice(["in_progress", "blocked", "completed"])}
        rows.append({"event_type": kind, "task_id": rng.choice([f"t{rng.randrange(12)}", "hot", None]), "project_id": f"p{rng.randrange(3)}", "payload": payload})
    return events_frame(spark, rows)


def rows_of(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


def test_model_equals_fold_for_any_cut_and_order(spark, tmp_path):
    for seed in range(3):
        log, rng = log_of(spark, 200, seed), random.Random(seed)
        cuts = sorted(rng.sample(range(1, 200), 6))
        parts = [log.where((F.col("log_seq") > a) & (F.col("log_seq") <= b)) for a, b in zip([0, *cuts], [*cuts, 200])]
        rng.shuffle(parts)
        model = readmodels.task_board(str(tmp_path / f"board{seed}"), every=3)
        for number, part in enumerate(parts):
            model.add(part, number)
            if number == 4:
                model.add(part, number)  # a batch that comes again
        assert rows_of(model.read(spark)) == rows_of(folds.task_board(log))


def test_model_reads_no_more_than_base_and_batches(spark, tmp_path):
    model = readmodels.task_board(str(tmp_path / "board"), every=2)
    assert model.read(spark) is None
    log = log_of(spark, 90, 7)
    for number in range(9):
        model.add(log.where((F.col("log_seq") > 10 * number) & (F.col("log_seq") <= 10 * number + 10)), number)
    parts = model._parts(spark)
    assert [os.path.basename(p) for p in parts] == ["base-7", "batch-8"]
    kept = sorted(p for p in os.listdir(tmp_path / "board") if p.startswith(("base", "batch")))
    assert kept == ["base-5", "base-7", "batch-6", "batch-7", "batch-8"]
    # A base that was not finished is not read.
    shutil.copytree(tmp_path / "board" / "base-7", tmp_path / "board" / "base-8")
    os.remove(tmp_path / "board" / "base-8" / "_SUCCESS")
    assert [os.path.basename(p) for p in model._parts(spark)] == ["base-7", "batch-8"]
    assert rows_of(model.read(spark)) == rows_of(folds.task_board(log))


def test_registry_as_a_model(spark, tmp_path):
    log = events_frame(spark, [{"event_type": "agent.registered", "payload": {"name": n, "capability": c, "executor": x}} for n, c, x in [("a", "one", None), ("b", "two", "external"), ("a", "three", None), (None, "x", None)]])
    model = readmodels.agent_registry(str(tmp_path / "agents"))
    for number in range(2):
        model.add(readmodels.registrations(log.where(F.col("log_seq") % 2 == number)), number)
    assert rows_of(model.read(spark)) == rows_of(folds.agent_registry(log))


def test_fields_merge(spark):
    log = log_of(spark, 120, 9)
    fields = {
        "first": merging.first_of(lambda: F.col("event_type")),
        "last": merging.last_of(lambda: F.col("event_type"), lambda: F.col("event_type") != "agent.heartbeat"),
        "any": merging.any_of(lambda: F.col("event_type") == "task.created"),
        "n": merging.count_of(lambda: F.lit(True)),
        "most": merging.most_of(lambda: F.col("log_seq")),
    }
    whole = merging.values_of(merging.fold_part(log, "task_id", fields), "task_id", fields)
    parts = merging.fold_part(log.where("log_seq > 50"), "task_id", fields).union(merging.fold_part(log.where("log_seq <= 50"), "task_id", fields))
    assert rows_of(merging.values_of(merging.merge_parts(parts, "task_id", fields), "task_id", fields)) == rows_of(whole)


def send(folder, number, *events):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"log_seq": seq, "event_type": "task.created", "task_id": "t", "idempotency_key": key, "payload": {"title": title}}) for seq, key, title in events]
    (folder / f"{number}.json").write_text("\n".join(lines))
    os.utime(folder / f"{number}.json", (1_700_000_000 + 10 * number,) * 2)


def test_ingest_reads_nothing_of_the_log(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("log", "conflicts", "checkpoint")}
    folder = tmp_path / "in"

    def run():
        query = ingest.ingest(ingest.read_log(spark, str(folder), 1), at["log"], at["conflicts"], at["checkpoint"])
        query.awaitTermination(120)
        assert query.exception() is None

    send(folder, 0, (2, "k", "late"), (1, "k", "first"), (3, None, "x"), (4, None, "x"), (5, "m", "m"))
    run()
    seqs = lambda name: sorted(r["log_seq"] for r in spark.read.schema(EVENT).parquet(f"{at[name]}/*").collect())
    assert seqs("log") == [1, 3, 4, 5] and seqs("conflicts") == [2]
    # The log is gone; what is known of the keys is not in it.
    shutil.move(at["log"], str(tmp_path / "away"))
    send(folder, 1, (6, "k", "first"), (7, "k", "other"), (8, "n", "n"), (9, "n", "n"), (10, None, "x"))
    send(folder, 2, (11, "m", "m"), (12, "n", "N"))
    run()
    assert seqs("log") == [8, 10] and seqs("conflicts") == [2, 7, 12]
    assert set(os.listdir(at["log"])) == {"batch=1", "batch=2"}
    run()  # nothing new
    assert seqs("log") == [8, 10]
