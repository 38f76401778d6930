"""Hand-made cases of reviews, versions, titles, teams and escalations."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.model import events_frame
from ledgerloom.operators import folds, monitors, review, teams
from ledgerloom.operators.running import with_previous


def ev(kind, task="t1", at=0.0, project="p1", key=None, user=None, **payload):
    return {"event_type": kind, "task_id": task, "project_id": project, "created_at_ts": float(at), "idempotency_key": key, "user_id": user, "payload": payload}


def in_review(task, title="写说明", **more):
    rows = [ev("task.created", task, title=title), ev("task.state_changed", task, to="in_review"), ev("review.requested", task, review_id=f"r-{task}")]
    if more.get("file"):
        rows.insert(1, ev("deliverable.submitted", task, file_ref=more["file"]))
    return rows


def test_reviews_that_need_no_person(spark):
    rows = [
        ev("agent.registered", None, name="robot"), *in_review("ok", file="a.md"), *in_review("empty"),
        *in_review("human", file="a.md"), ev("agent.assigned", "human", agent="Ann", role="reviewer"),
        *in_review("agent", file="a.md"), ev("agent.assigned", "agent", agent="robot", role="reviewer"),
        *in_review("done", file="a.md"), ev("review.decided", "done", review_id="r-done", verdict="pass"),
        *in_review("sums", "汇总表", file="a.md"), *in_review("rates", "比率表", file="b.md"), *in_review("unasked", "统计", file="c.md"),
        *in_review("other state", file="a.md"), ev("task.state_changed", "other state", to="in_progress"),
    ]
    log = events_frame(spark, rows)
    answers = spark.createDataFrame(
        [("sums", "a.md", 'x {"verdict":"PASS","note":"好"}'), ("rates", "b.md", '{"verdict": "CHECK"}'), ("ok", "a.md", "unasked")], "task_id string, file_ref string, answer string"
    )
    checks = review.recheck(log, answers)
    got = {r["task_id"]: (r["verdict"], r["note"], r["checked"], r["idempotency_key"]) for r in checks.collect()}
    assert got["sums"] == ("PASS", "好", True, "auto:recheck:sums:a.md") and got["rates"][:2] == ("CHECK", '{"verdict": "CHECK"}')
    assert got["ok"] == ("SKIP", None, False, None) and got["unasked"] == ("NA", None, False, None)
    decided = {r["task_id"]: (r["verdict"], r["next_state"]) for r in review.auto_review(log, checks).collect()}
    assert decided == {"ok": ("pass", "completed"), "empty": ("needs_changes", "in_progress"), "agent": ("pass", "completed"), "sums": ("pass", "completed")}
    assert review.auto_review(log).where("task_id = 'sums'").count() == 0
    assert review.auto_review(log.limit(0)).count() == 0


def test_versions_guard_changes(spark):
    changes = spark.createDataFrame(
        [("a", 1, "in_progress", 0), ("a", 2, "blocked", 0), ("a", 3, "blocked", None), ("a", 4, "todo", 2), ("b", 5, "x", None)], "task_id string, log_seq long, to string, expected_version long"
    )
    got = {r["log_seq"]: (r["version"], r["accepted"]) for r in review.versioned(changes).collect()}
    assert got == {1: (0, True), 2: (1, False), 3: (1, True), 4: (2, True)}
    assert [tuple(r) for r in review.stale_versions(changes).collect()] == [("a", 2, 0, 1)]


def test_a_log_only_grows(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "log_seq long, x string")
    after = spark.createDataFrame([(1, "a"), (2, "c"), (4, "new")], "log_seq long, x string")
    assert {tuple(r) for r in review.append_only(before, after).collect()} == {(2, "updated"), (3, "deleted")}
    assert review.append_only(before, before).count() == 0


def test_lookups_and_titles(spark):
    log = events_frame(
        spark,
        [
            ev("project.created", None, user="u", title="P"), ev("task.created", title="T"), ev("approval.requested", approval_id="x", scope="s", signers=["me"]),
            ev("approval.requested", "gone", 5, "q", approval_id="y", signers=["me", "you"]), ev("approval.requested", approval_id="z", signers=["you"]),
            ev("agent.transferred", agent="a", key="k"), ev("agent.transferred", agent="b", key="k"), ev("user.registered", None, user="2", name="Zoe"), ev("user.registered", None, user="1", name="Ann"),
        ],
    )
    rows = review.pending_with_titles(log, "me").collect()
    assert [(r["approval_id"], r["project_title"], r["task_title"]) for r in rows] == [("y", "", ""), ("x", "P", "T")]
    assert [r["agent"] for r in review.last_transfer(log).collect()] == ["b"]
    assert review.find_key(log, "k").first()["payload"]["agent"] == "a" and review.find_key(log, "none").count() == 0
    assert [r["name"] for r in review.users_by_name(log).collect()] == ["Ann", "Zoe"]


def test_titles_resolve_within_a_batch(spark):
    drafts = spark.createDataFrame(
        [(1, 0, "i0", "A", ["B", "A", "nobody", "C"]), (1, 1, "i1", "B", []), (1, 2, "i2", "C", None), (1, 3, "i3", "C", ["A"]), (2, 0, "i4", "D", ["A"])],
        "batch int, pos int, task_id string, title string, depends_on array<string>",
    )
    got = {(r["batch"], r["pos"]): (r["task_id"], r["depends_on"]) for r in review.resolve_titles(drafts).collect()}
    assert got[(1, 0)] == ("i0", ["i1", "i3"]) and got[(1, 1)] == ("i1", []) and got[(1, 2)] == ("i3", []) and got[(1, 3)] == ("i3", ["i0"]) and got[(2, 0)] == ("i4", [])


def test_evidence(spark):
    files = spark.createDataFrame([("a", "内容" * 300), ("b", None)], "file_ref string, content string")
    a, b = review.evidence(files).orderBy("file_ref").collect()
    assert (a["content_len"], len(a["preview"]), len(a["content_hash"]), a["file_missing"]) == (600, 500, 16, False)
    assert (b["content_len"], b["file_missing"]) == (None, True)


def test_disabled_agents_and_hints_for_reviewers(spark):
    agents = spark.createDataFrame(
        [(0, "Ann", "taxlaw", "builtin", "disabled"), (1, "Bob", "tax-law x", "external", None), (2, "Cy", "other", "builtin", "available")],
        "pos int, name string, capability string, executor string, status string",
    )
    tasks = spark.createDataFrame([("1", "a law", ""), ("2", "zz", "ann"), ("3", "a", "")], "task_id string, title string, hint string")
    owners = teams.match_owner(tasks, agents)
    assert {r["task_id"]: r["owner"] for r in owners.collect()} == {"1": "Bob", "2": "Cy", "3": "Cy"}
    nobody = teams.match_owner(tasks, agents.where("executor = 'external'"))
    assert {r["task_id"]: r["owner"] for r in nobody.collect()} == {"1": "Bob", "2": None, "3": None}
    hinted = spark.createDataFrame([("1", "Bob", "CY"), ("2", "Cy", "cy"), ("3", None, None)], "task_id string, owner string, reviewer_hint string")
    assert {r["task_id"]: r["reviewer"] for r in teams.match_reviewer(hinted, agents).collect()} == {"1": "Cy", "2": "Bob", "3": "Bob"}


def test_permissions(spark):
    asked = spark.createDataFrame([(0, "read_project"), (0, "change_task_state"), (3, "pause_project"), (3, "approve_action"), (4, "external_irreversible"), (None, "unknown")], "level int, action string")
    assert [r["outcome"] for r in teams.permissions(asked).collect()] == ["allowed", "denied", "approval", "allowed", "approval", "allowed"]


def test_escalations_go_by_legal_steps(spark):
    late = spark.createDataFrame([("x", "new"), ("y", "busy"), ("z", "done"), ("w", "unknown")], "transfer_id string, task_id string")
    states = spark.createDataFrame([("new", "todo"), ("busy", "in_progress"), ("done", "completed")], "task_id string, status string")
    rows = monitors.transfer_escalations(late, states).orderBy("task_id", "step").collect()
    assert [(r["task_id"], r["from_state"], r["to_state"]) for r in rows] == [
        ("busy", None, None), ("busy", "in_progress", "blocked"), ("new", None, None), ("new", "todo", "in_progress"), ("new", "in_progress", "blocked"),
        ("unknown", None, None), ("unknown", "todo", "in_progress"), ("unknown", "in_progress", "blocked"),
    ]
    assert len({r["idempotency_key"] for r in rows}) == len(rows)
    tasks = spark.createDataFrame([("new", ["done"]), ("busy", []), ("unknown", ["busy"])], "task_id string, depends_on array<string>")
    assert [r["task_id"] for r in monitors.auto_starts(tasks, states).collect()] == ["new"]


def test_previous_values_cross_blocks(spark):
    rows = spark.createDataFrame([("a", n, str(n)) for n in (1, 9, 10, 11, 25)] + [(None, 3, "x")], "k string, n long, v string")
    got = {(r["k"], r["n"]): r["before"] for r in with_previous(rows, "k", "n", "v", "before", default="-", block=10).collect()}
    assert got == {("a", 1): "-", ("a", 9): "1", ("a", 10): "9", ("a", 11): "10", ("a", 25): "11", (None, 3): "-"}


def test_an_owner_stays_when_a_project_is_created_anew(spark):
    log = events_frame(spark, [ev("project.created", None, user="u", title="A", goal="g"), ev("project.created", None, title="B")])
    row = folds.project_list(log).first()
    assert (row["title"], row["owner"], row["goal"]) == ("B", "u", "g")


def test_notifications_reach_owners_and_signers(spark):
    rows = [
        ev("project.created", None, user="u", title="P"), ev("task.state_changed", at=1, to="blocked"), ev("review.decided", at=2, verdict="pass"),
        ev("approval.requested", "x", 3, "other", approval_id="a", scope="s", signers=["Ann", "Bob"]), ev("approval.requested", "x", 4, "other", approval_id="b", scope="alone"),
        ev("approval.signers_set", "x", 5, "other", approval_id="a", signers=["Ann", "Cy"]), ev("approval.signed", "x", 6, "other", approval_id="a", signer="Ann", result="reject"),
        ev("approval.decided", "x", 7, "other", approval_id="a", result="approve"), ev("agent.execution_failed", at=8), ev("agent.heartbeat", at=9),
    ]
    log = events_frame(spark, rows)
    told = lambda viewer, name=None: [r["summary"] for r in folds.notifications(log, viewer, name).collect()]
    assert told("u") == ["", "复核结论: pass", "任务状态 → blocked"]
    ann = ["审批: 已批准", "会签：Ann 已驳回", "会签人已设置（2 人）：Ann、Cy", "会签请求（2 人）：s"]
    assert told("nobody", "Ann") == ann and told("nobody", "Bob") == [] and told("u", "Cy") == ["", *ann, "复核结论: pass", "任务状态 → blocked"]
    assert "审批请求：alone" in told(None) and len(told(None)) == 8


def test_a_log_in_a_database(spark, tmp_path):
    import datetime as dt

    from ledgerloom.sources import files

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(k, "task.created", "a", "p", f"t{k}", "u", f"k{k}", dt.datetime(2024, 1, 1, 0, 0, k), '{"title": "T%d"}' % k) for k in range(1, 41)]
    schema = "id long, event_type string, actor string, project_id string, task_id string, user_id string, idempotency_key string, created_at timestamp, payload string"
    spark.createDataFrame(rows, schema).write.option("createTableColumnTypes", ", ".join(f"{c.split()[0]} VARCHAR(500)" for c in schema.split(", ") if c.endswith("string"))).jdbc(url, "events", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    log = files.read_events_jdbc(spark, url, partitions=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert log.rdd.getNumPartitions() == 4 and log.count() == 40
    assert folds.task_board(log).where("task_id = 't7'").first()["title"] == "T7"
    assert review.find_key(log, "k9").first()["created_at_ts"] == dt.datetime(2024, 1, 1, 0, 0, 9, tzinfo=dt.UTC).timestamp()


def test_workers_keep_their_own_state(spark, tmp_path):
    import json
    import os

    from ledgerloom.streaming import ingest, workers

    class Counter(workers.Worker):
        emits, keeps = "task_id string, n long, last string", "n long"

        def start(self):
            return (0,)

        def process(self, task_id, events, state):
            n = state[0] + len(events)
            return [(task_id, n, events.event_type.iloc[-1])], (n,)

    folder = tmp_path / "in"
    folder.mkdir()
    for k, kinds in enumerate([["task.created", "agent.heartbeat"], ["agent.heartbeat"], []]):
        path = folder / f"{k}.json"
        path.write_text("\n".join(json.dumps({"log_seq": 10 * k + i, "event_type": e, "task_id": "t"}) for i, e in enumerate(kinds)) + json.dumps({"log_seq": 99 + k, "event_type": "goal.parsed"}).join("\n\n"))
        os.utime(path, (1_700_000_000 + 10 * k,) * 2)
    out = workers.run(ingest.read_log(spark, str(folder), 1), Counter())
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("t", 2, "agent.heartbeat"), ("t", 3, "agent.heartbeat")]


def test_orphans_opinions_and_templates(spark):
    log = events_frame(spark, [ev("task.created", "a", title="A"), ev("task.created", "b", project=None, title="B"), ev("review.decided", "a", opinion="first", verdict="reject"), ev("review.decided", "a", opinion="", verdict="pass")])
    assert folds.task_board(log).count() == 2 and [r["task_id"] for r in folds.task_board(log, orphans=False).collect()] == ["a"]
    assert [tuple(r) for r in monitors.latest_opinions(log).collect()] == [("a", "first", "reject")]
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    assert [r["name"] for r in teams.unregistered(names("x", "y"), names("x")).collect()] == ["y"]


def test_language_routes(spark):
    from ledgerloom.operators import retrieval

    vectors = spark.createDataFrame([(1, [1.0, 0.0], "en"), (2, [0.9, 0.1], "zh")], "vec_id int, embedding array<float>, lang string")
    ids = lambda **k: [r["vec_id"] for r in retrieval.routed_search(vectors, [1.0, 0.0], F.col("lang"), **k).collect()]
    assert ids(english_query=True, has_reranker=False) == [1] and ids(english_query=True, has_reranker=True) == [1, 2]
    assert ids(english_query=False, has_reranker=True) == [2] and ids(english_query=False, has_reranker=False) == [2]
    pooled = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0])], "t array<array<float>>, m array<int>").select(retrieval.mean_pooled("t", "m").alias("v")).collect()
    assert [round(x, 6) for x in pooled[0]["v"]] == [0.6, 0.8] and pooled[1]["v"] == [0.0, 0.0]


def test_very_many_small_blocks_are_passed_over_in_order(spark):
    """Blocks are no groups of their own, each with its call; batches may end anywhere in a block."""
    rng = random.Random(5)
    rows = [(f"t{rng.randrange(6)}", s, "x", rng.choice([None, 0, 1, 2, 3])) for s in range(400)] + [("t1", None, "x", 1), (None, 401, "x", 1)]
    changes = spark.createDataFrame(rows, "task_id string, log_seq long, to string, expected_version long")
    want, at = {}, {}
    for task, s, _, e in rows[:400]:
        v = at.get(task, 0)
        want[s] = (v, e is None or e == v)
        at[task] = v + want[s][1]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for block in (1, 7, 1000):
            done = review.versioned(changes, block)
            assert "FlatMapGroups" not in done._jdf.queryExecution().executedPlan().toString()
            assert {r["log_seq"]: (r["version"], r["accepted"]) for r in done.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
