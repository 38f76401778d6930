"""Streaming monitors: alerts once for each episode, as event time moves on."""

from __future__ import annotations

import json
import os

import random

from pyspark.sql import functions as F

from ledgerloom.operators import folds
from ledgerloom.operators import monitors as batch_monitors
from ledgerloom.sources import files
from ledgerloom.streaming import ingest, monitors, readmodels


def write(folder, name, *events):
    lines = []
    for seq, kind, task, at, payload in events:
        lines.append(json.dumps({"log_seq": seq, "event_type": kind, "task_id": task, "created_at_ts": at, "payload": payload}))
    path = folder / f"{name}.jsonl"
    path.write_text("\n".join(lines))
    os.utime(path, (1_700_000_000 + 10 * int(name),) * 2)  # files come in the order of their times


def alerts(spark, tmp_path, monitor, *batches):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k, batch in enumerate(batches):
        write(folder, f"{k:02d}", *batch)
    found = monitor(ingest.read_log(spark, str(folder), files_per_batch=1))
    query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(out)


STATE = "task.state_changed"


def test_silence_is_told_once_an_episode(spark, tmp_path):
    rows = alerts(
        spark, tmp_path, lambda s: monitors.silent_tasks(s, timeout_s=100, late="1 second"),
        [(1, STATE, "a", 1000, {"to": "in_progress"}), (2, STATE, "b", 1000, {"to": "in_progress"}), (3, STATE, "c", 1000, {"to": "blocked"})],
        [(4, "agent.heartbeat", "b", 1090, {}), (5, "agent.heartbeat", "a", 1050, {})],
        [(6, STATE, "z", 1180, {"to": "todo"})],
        [(7, STATE, "b", 1185, {"to": "completed"}), (8, STATE, "a", 1300, {"to": "blocked"})],
        [(9, STATE, "a", 1400, {"to": "in_progress"})],
        [(10, STATE, "z", 2000, {"to": "todo"})],
        [(11, STATE, "z", 2001, {"to": "todo"})],
    ).collect()
    assert sorted((r["task_id"], r["since"], r["last_seen"]) for r in rows) == [("a", 1000.0, 1050.0), ("a", 1400.0, 1400.0)]
    assert len({r["idempotency_key"] for r in rows}) == 2


def test_deadlines_warn_and_then_alert(spark, tmp_path):
    rows = alerts(
        spark, tmp_path, lambda s: monitors.deadline_tasks(s, lead_s=50, late="1 second"),
        [(1, "task.created", "a", 1000, {"deadline_ts": 1200.0}), (2, "task.created", "b", 1000, {"deadline_ts": 1200.0}), (3, "task.created", "c", 1000, {})],
        [(4, STATE, "z", 1170, {"to": "todo"})],
        [(5, STATE, "b", 1180, {"to": "completed"})],
        [(6, STATE, "z", 1300, {"to": "todo"})],
        [(7, STATE, "z", 1301, {"to": "todo"})],
    ).collect()
    assert sorted((r["task_id"], r["kind"]) for r in rows) == [("a", "overdue"), ("a", "warning"), ("b", "warning")]


def life(seed):
    """A log in batches, cut anywhere, with a last event far behind that moves the watermark."""
    rng, rows, at = random.Random(seed), [], 1000.0
    for name in ("in", "out", "new"):
        rows.append(("agent.registered", None, at, {"name": name, "executor": "builtin" if name == "in" else "external"}))
    rows.append(("agent.registered", None, at, {"name": "new", "executor": "builtin"}))
    for _ in range(160):
        at += rng.choice([1, 20, 90])
        task = f"t{rng.randrange(14)}"
        kind = rng.choice([STATE, STATE, STATE, "agent.heartbeat", "agent.assigned", "agent.assigned", "handover.created", "task.stalled"] if rng.random() < 0.15 else [STATE, STATE, "agent.heartbeat", "agent.assigned"])
        payload = {"to": rng.choice(["in_progress", "in_progress", "blocked", "completed"])} if kind == STATE else {"agent": rng.choice(["in", "out", "new", "none"]), "role": rng.choice(["owner", None, "reviewer"])} if kind == "agent.assigned" else {}
        rows.append((kind, task, at, payload))
    rows = [(seq, kind, task, when, payload) for seq, (kind, task, when, payload) in enumerate(rows, 1)]
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    end = at + 5000
    return [*batches, [(900, STATE, "z", end, {"to": "todo"})], [(901, STATE, "z", end + 1, {"to": "todo"})]], end


def test_blocked_stream_equals_batch(spark, tmp_path):
    batches, end = life(1)
    told = alerts(spark, tmp_path, lambda s: monitors.blocked_tasks(s, timeout_s=600, late="1 second"), *batches)
    want = batch_monitors.blocked_escalation(files.read_events(spark, str(tmp_path / "in")), end, 600).collect()
    # An episode that is over by now may have been told as well. The owner is that of the moment at which it is told.
    got = {(r["task_id"], r["since"]): r["owner"] for r in told.collect()}
    assert want and {(r["task_id"], r["since"]) for r in want} <= got.keys()
    own = [(seq, task, at, p["agent"]) for rows in batches for seq, kind, task, at, p in rows if kind == "agent.assigned" and p.get("role") != "reviewer"]
    for (task, since), owner in got.items():
        assert owner == max(((seq, a) for seq, t, at, a in own if t == task and at <= since + 600), default=(0, None))[1]
    assert len({r["idempotency_key"] for r in told.collect()}) == told.count()


def test_stalled_stream_equals_batch(spark, tmp_path):
    for seed in (2, 3):
        top = tmp_path / str(seed)
        folder = top / "in"
        folder.mkdir(parents=True)
        batches, end = life(seed)
        for k, rows in enumerate(batches):
            write(folder, f"{k:02d}", *rows)
        model = readmodels.agent_registry(str(top / "agents"))
        _, query = monitors.run_stalled(ingest.read_log(spark, str(folder), 1), model, str(top / "out"), str(top / "cp"), timeout_s=1800, late="1 second")
        query.awaitTermination(120)
        assert query.exception() is None
        log = files.read_events(spark, str(folder))
        want = {(r["task_id"], r["owner"], r["last_act"]) for r in batch_monitors.stalled(log, folds.agent_registry(log), end, 1800).where(F.col("task_id") != "z").collect()}
        got = [(r["task_id"], r["owner"], r["last_seen"]) for r in spark.read.parquet(str(top / "out")).collect()]
        assert want and {t for t, _, _ in want} <= {t for t, _, _ in got} and len({t for t, _, _ in got}) == len(got)
        for task, owner, seen in got:  # what was told in between is what the batch tells at that moment
            then = batch_monitors.stalled(log.where(F.col("created_at_ts") <= seen + 1800), folds.agent_registry(log), seen + 1800, 1800)
            assert (task, owner, seen) in want or then.where(F.col("task_id") == task).select("task_id", "owner", "last_act").collect() == [(task, owner, seen)]
