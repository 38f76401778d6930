"""Small hand-made cases for what the tables do not hold: Chinese texts, approvals, packs, files, streams."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.model import EVENT, events_frame, transition_table
from ledgerloom.operators import approvals, chunks, clauses, documents, folds, monitors, packs, retrieval, teams
from ledgerloom.operators.running import with_earlier_blocks
from ledgerloom.sources import files
from ledgerloom.streaming import ingest, readmodels

TASK = "11111111-2222-3333-4444-555555555555"


def log(spark, *rows):
    return events_frame(spark, [dict(r) for r in rows])


def ev(kind, task="t1", at=0.0, project="p1", key=None, user=None, **payload):
    return {"event_type": kind, "task_id": task, "project_id": project, "created_at_ts": float(at), "idempotency_key": key, "user_id": user, "payload": payload}


def one(df):
    (row,) = df.collect()
    return row


def board(spark):
    return log(
        spark, ev("project.created", None, user="u", title="P", goal="G"), ev("task.created", title="T", description="D"), ev("agent.assigned", agent="heron"),
        ev("agent.assigned", agent="owl", role="qa"), ev("task.state_changed", to="in_progress"), ev("deliverable.submitted", file_ref="a.md"),
    )


def test_board_is_a_fold_of_the_log_in_any_order(spark):
    events = board(spark)
    for frame in (events, events.orderBy(F.desc("log_seq")).repartition(5), events.union(events)):
        r = one(folds.task_board(frame))
        assert (r["title"], r["owner"], r["reviewer"], r["status"], r["has_deliverable"]) == ("T", "heron", "owl", "in_progress", True)
    assert one(folds.task_context(events))["deliverables"] == ["a.md"]
    assert one(folds.project_list(events, "u"))["status"] == "active" and folds.project_list(events, "v").count() == 0
    assert one(folds.project_list(events))["title"] == "P"
    assert folds.task_board(events.limit(0)).count() == 0


def test_projects_come_back_when_created_anew(spark):
    events = [ev("project.created", None, user="u", title="A"), ev("project.archived", None)]
    assert folds.project_list(log(spark, *events)).count() == 0
    assert one(folds.project_list(log(spark, *events, ev("project.created", None, user="u", title="B"))))["title"] == "B"
    assert one(folds.project_list(log(spark, events[0], ev("project.paused", None))))["status"] == "paused"


def test_registry_usage_versions_and_rework(spark):
    events = log(
        spark, ev("agent.registered", None, name="a", capability="x"), ev("agent.registered", None, name="a", capability="y", executor="external"),
        ev("usage.recorded", None, label="L", input_tokens=10, output_tokens=5), ev("usage.recorded", None, input_tokens=1),
        ev("deliverable.submitted", file_ref="1"), ev("review.decided", verdict="reject"), ev("deliverable.submitted", file_ref="2"),
    )
    r = one(folds.agent_registry(events))
    assert (r["capability"], r["executor"]) == ("y", "external")
    usage = {r["label"]: (r["calls"], r["input_tokens"], r["output_tokens"]) for r in folds.usage(events).collect()}
    assert usage == {None: (2, 11, 5), "L": (1, 10, 5), "?": (1, 1, 0)}
    assert [r["version"] for r in folds.deliverable_versions(events).orderBy("log_seq").collect()] == [1, 2]
    assert one(folds.rework_counts(events, limit=1))["stopped"]


def test_transitions_and_reviews(spark):
    events = log(spark, ev("task.state_changed", to="in_progress"), ev("task.state_changed", to="completed"), ev("review.requested", review_id="1"), ev("review.requested", review_id="2"), ev("review.decided", review_id="1"))
    bad = one(folds.illegal_transitions(events, transition_table(spark)))
    assert (bad["from_state"], bad["to_state"]) == ("in_progress", "completed")
    assert one(folds.open_reviews(events))["review_id"] == "2"


def signed(spark, rule, *votes, signers=("a", "b")):
    events = [ev("approval.requested", approval_id="1", signers=list(signers), rule=rule, scope="s")]
    return approvals.approvals(log(spark, *events, *[ev("approval.signed", approval_id="1", signer=s, result=r) for s, r in votes]))


def test_countersigning(spark):
    outcome = lambda *a, **k: one(approvals.outcome(signed(spark, *a, **k)))["outcome"]
    yes, no = "approve", "reject"
    assert outcome(None, ("a", yes)) is None and outcome(None, ("a", yes), ("b", yes)) == yes
    assert outcome("all", ("b", no)) == no and outcome("any", ("b", yes)) == yes
    assert outcome("any", ("a", no)) is None and outcome("any", ("a", no), ("b", no)) == no
    assert outcome("any", ("stranger", yes)) is None and outcome("all", ("a", yes), signers=()) is None
    p = one(approvals.progress(signed(spark, "all", ("a", no), ("a", yes))))
    assert (p["total"], p["signed"], p["approved"], p["rejected"], p["pending"]) == (2, 1, 1, 0, ["b"])
    assert one(approvals.pending_for(signed(spark, "all", ("a", yes)), "a"))["own_vote"] == yes
    assert approvals.pending_for(signed(spark, "all", ("a", yes), ("b", yes)), "a").count() == 0
    assert approvals.pending_for(signed(spark, "all"), "x").count() == 0
    names = spark.createDataFrame([("a, b，b、 ,c",)], "s string").select(approvals.parse_signers("s").alias("n"))
    assert one(names)["n"] == ["a", "b", "c"]


def test_monitors(spark):
    events = log(
        spark, ev("task.created", at=0), ev("agent.assigned", at=1, agent="bot"), ev("task.state_changed", at=10, to="in_progress"),
        ev("task.state_changed", at=50, to="blocked"), ev("task.state_changed", at=60, to="in_progress"), ev("agent.heartbeat", at=100),
    )
    assert one(monitors.current_episode(events))["since"] == 60
    assert monitors.heartbeat_silence(events, 399).count() == 0
    assert one(monitors.heartbeat_silence(events, 401))["silent_s"] == 301
    registry = spark.createDataFrame([("x", "builtin")], "name string, executor string")
    assert one(monitors.stalled(events, registry, 1900))["owner"] == "bot" and monitors.stalled(events, registry, 1899).count() == 0
    assert monitors.stalled(events, spark.createDataFrame([("bot", "builtin")], "name string, executor string"), 9e9).count() == 0
    tasks = spark.createDataFrame([("a", "todo", 100.0), ("b", "completed", 100.0), ("c", "todo", None)], "task_id string, status string, deadline_ts double")
    assert one(monitors.deadline_alerts(tasks, 100))["kind"] == "overdue" and one(monitors.deadline_alerts(tasks, 99))["kind"] == "warning"
    letters = spark.createDataFrame([("1", TASK, 0.0), ("2", "no uuid", 0.0)], "transfer_id string, task_id string, created_ts double")
    assert one(monitors.stale_transfers(letters, events, 2000))["transfer_id"] == "1"
    assert monitors.stale_transfers(letters, log(spark, ev("deliverable.submitted", TASK)), 2000).count() == 0


def test_dependencies(spark):
    tasks = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a", "gone"]), ("d", None)], "task_id string, depends_on array<string>")
    states = spark.createDataFrame([("a", "completed")], "task_id string, status string")
    assert {r["task_id"]: r["ready"] for r in monitors.deps_ready(tasks, states).collect()} == {"a": True, "b": True, "c": False, "d": True}


def test_teams(spark):
    agents = spark.createDataFrame([(0, "Ann", "tax law", "builtin"), (1, "Bob", "design", "external"), (2, "Cy", "law", "builtin")], "pos int, name string, capability string, executor string")
    tasks = spark.createDataFrame([("1", "about design", ""), ("2", "law of tax", ""), ("3", "zzz", ""), ("4", "law", "BOB")], "task_id string, title string, hint string")
    owners = teams.match_owner(tasks, agents)
    assert {r["task_id"]: r["owner"] for r in owners.collect()} == {"1": "Bob", "2": "Ann", "3": "Ann", "4": "Ann"}
    assert all(r["reviewer"] != r["owner"] for r in teams.match_reviewer(owners, agents).collect())


def apply(spark, text, f):
    return one(spark.createDataFrame([(text,)], "t string").select(f("t").alias("x")))["x"]


def test_text_functions(spark):
    run = lambda text, f: apply(spark, text, f)
    assert run("电话 13812345678，邮箱 a.b@cc.cn", tx.redact) == "电话 [手机号]，邮箱 [邮箱]"
    assert run("收入1,200万元和3元", tx.mask_amounts) == "收入[金额≈千万级]和[金额]"
    assert run("TaxTax report", tx.collapse_doubled) == "TaxTax report" and run("ReportReport", tx.collapse_doubled) == "Report"
    assert run("持股 100%、60%和12%，2024年3月5日", tx.generalize) == "持股 [全资]、[控股]和[参股]，2024年"
    assert run("---\ntitle: 出海架构\ntopic: x\n---\nbody", lambda c: tx.front_matter(c, "title")) == "出海架构"
    assert run("---\ntitle: a\n---\n\nbody", tx.body) == "body"
    assert run('x {"a": 1} y', tx.json_object) == '{"a": 1}'
    assert run("v1.2.10-beta", tx.version_array) == [1, 2, 10]
    assert run("香港 的 tax 我们 A1", tx.terms_col) == ["香港", "tax", "A1"]
    assert run("中文占多数的文本", tx.is_english) is False and run("mostly English", tx.is_english) is True


def test_clauses(spark):
    text = "总则\n第一条 增值税是指对货物征收的税。一、免征项目；二、报送备案。\n第二条 印花税"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = clauses.cut(docs).orderBy("clause_no").collect()
    assert [r["unit"] for r in rows] == ["", "第一条", "一", "二", "第二条"]
    assert "".join(r["text"] for r in rows) == text.replace("\n", "")
    assert apply(spark, "土地使用税和契税（注：关税不算）", clauses.taxes) == ["契税", "城镇土地使用税"]
    assert apply(spark, "没有关键词", clauses.rules) == ["一般规定"]
    assert one(spark.createDataFrame([("- 【税法 第一条】内容",)], "l string").select(clauses.parse_line("l").alias("p")))["p"]["unit"] == "第一条"
    batches = spark.createDataFrame([("b", "d", "u", "same  text", 2, 1), ("b", "d", "u", "same text", 1, 1), ("b", "d", "v", "x", 1, 2)], "bucket string, doc string, unit string, rest string, batch int, pos int")
    assert sorted((r["unit"], r["batch"]) for r in clauses.merge(batches).collect()) == [("u", 1), ("v", 1)]


def test_document_numbers_and_repeals(spark):
    assert apply(spark, "财税〔2019〕13号", clauses.document_numbers) == ["财税|年号|2019|13", "~|年号|2019|13"]
    rows = [
        ("新办法", "《旧办法》（财税〔2009〕13号）同时废止。《其他规定》第三条废止。", []),
        ("旧办法的名称不同", "正文。", ["财税|年号|2009|13"]),
        ("关于旧事项若干具体规则的通知", "正文。", []),
        ("另一新办法", "《旧事项若干具体规则》同时废止", []),
    ]
    docs = spark.createDataFrame(rows, "doc string, text string, nums array<string>")
    found = clauses.resolve_repeals(clauses.repeals(docs), docs.select("doc", "nums"))
    assert {r["doc"]: (r["title"], r["target"], r["why"]) for r in found.collect()}["新办法"] == ("旧办法", "旧办法的名称不同", "number")


def test_chunks(spark):
    parts = spark.createDataFrame([(["a" * 500, "b" * 50, "c" * 200, "d" * 1000],)], "p array<string>").select(chunks.packed(F.col("p")).alias("x"))
    # The part that is cut up leaves the open chunk open; it closes last.
    assert [len(x) for x in one(parts)["x"]] == [551, 800, 200, 200]
    numbers = spark.createDataFrame([([2, 1, 2, 9, 4, 3],)], "n array<int>").select(chunks.accepted_numbers(F.col("n")).alias("x"))
    assert one(numbers)["x"] == [1, 2, 4]
    cut = apply(spark, "One. " * 400, chunks.split_long)
    assert max(map(len, cut)) <= 700 and sum(x.count("One.") for x in cut) == 400


def test_redaction_query_applies_every_rule(spark, tmp_path):
    import re

    from ledgerloom.plans import QUERIES

    cases = {
        "打 13812345678。": "打 [手机号]。",
        "打 138-1234 5678。": "打 [手机号]。",
        "座机 010-8888 9999 转": "座机 [电话] 转",
        "证件 11010519491231002X 号": "证件 [证件号] 号",
        "card 4111111111111111, 5500005555555559.": "card [证件号], [证件号].",
        "账号 6222 1234 5678 9123 456 开户": "账号 [账号] 开户",
        "mail a.b@cc.cn and x4111111111111111": "mail [邮箱] and x4111111111111111",
        "毕马威 plain 12345": "[事务所] plain 12345",
    }
    rows = list(enumerate([*cases, None, ""]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def slow(text):
        for pattern, by in tx.REDACTIONS:
            text = None if text is None else re.sub(pattern, by.replace("$1", r"\1"), text, flags=re.ASCII)
        return text

    got = {r["doc_id"]: r["text"] for r in QUERIES["redact_pii"](spark, str(tmp_path)).collect()}
    assert got == {k: slow(t) for k, t in rows}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_documents(spark):
    text = "\n".join(["Header", "a", "Header", "b", "Header", "c", "Header", "d", "Header"])
    assert apply(spark, text, lambda c: documents.drop_repeated_lines(c)).split("\n").count("Header") == 0
    rows = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    assert {r["kept"]: r["copies"] for r in documents.fingerprint_dedupe(rows).collect()} == {1: 2, 3: 1}
    empty = documents.fingerprint_dedupe(rows.limit(0))
    assert empty.count() == 0


def test_keyword_search(spark):
    docs = spark.createDataFrame([("a", "香港 股息 架构 香港"), ("b", "无关内容")], "doc_id string, text string")
    assert [r["doc_id"] for r in retrieval.keyword_search(docs, "香港 股息 架构").collect()] == ["a"]
    assert one(retrieval.context_block(retrieval.keyword_search(docs, "nonsense")))["context"] == ""
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["score"] for r in retrieval.vector_search(vectors, [2.0, 0.0], unit=False).collect()] == [1.0, 0.0]


def test_packs(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "shard string, text string")
    had = rows(("1", "a"), ("2", "b"))
    gone = spark.createDataFrame([], "shard string")
    got = packs.install(had, rows(("2", "new")), gone, full=False)
    assert sorted(map(tuple, got.collect())) == [("1", "a"), ("2", "new")]
    got = packs.install(had, had.limit(0), spark.createDataFrame([("1",)], "shard string"), full=False)
    assert [tuple(r) for r in got.collect()] == [("2", "b")]
    assert packs.choose_pack("1", 1, {"version": "2", "base": "0", "total_after": 2}) == "full"
    assert packs.choose_pack("2", 1, {"version": "2", "base": "1", "total_after": 2}) == "repair"
    assert packs.same_multiset(had.union(had), had.union(had)) and not packs.same_multiset(had, had.union(had))


def test_shards_are_hashed_in_blocks(spark):
    import hashlib
    from collections import Counter, defaultdict

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(i, f"text {i}", "hot" if i % 3 else "s") for i in range(9000)] + [(1, "text 1", "hot"), (7, None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    blocks = defaultdict(lambda: defaultdict(list))
    for (shard, d), n in Counter((r[2], sha(f"{r[0]}\x1f{r[1] or ''}")) for r in rows).items():
        blocks[shard][d[:3]].append(f"{d}:{n}")
    want = {s: sha("".join(sorted(k + sha("".join(sorted(v))) for k, v in b.items()))) for s, b in blocks.items()}
    got = packs.shard_manifest(docs).collect()
    assert {r["shard"]: r["hash"] for r in got} == want and sum(r["n"] for r in got) == len(rows)
    once = packs.shard_manifest(docs.dropDuplicates().where("source <> 'null'"))
    change = {r["shard"]: r["change"] for r in packs.shard_diff(packs.shard_manifest(docs), once).collect()}
    assert change == {"hot": "changed", "s": "same", "null": "added"}


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


def test_materials(spark):
    docx = zipped(word__document="<d><p><r><t>标题 收入</t></r><r><t>100</t></r></p><p><r><t>成本60</t></r></p></d>")
    xlsx = zipped(xl__sharedStrings="<s><si><t>苹果</t></si></s>", xl__worksheets__sheet1='<w><c r="A1" t="s"><v>0</v></c><c r="B1"><v>3.5</v></c></w>')
    rows = [("a.txt", b"apple,3.5"), ("b.docx", docx), ("c.xlsx", xlsx), ("d.sh", b"rm"), ("e.docx", b"broken"), ("f.png", b"x"), ("../g.txt", b"x")]
    got = {r["name"]: r for r in files.materials(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got.keys() == {"a.txt", "b.docx", "c.xlsx", "e.docx", "f.png"}
    assert got["b.docx"]["text"] == "标题 收入100\n成本60" and "苹果,3.5" in got["c.xlsx"]["text"]
    assert got["e.docx"]["note"] and got["f.png"]["note"] and got["a.txt"]["text_len"] == 9


def test_files(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.md").write_text("---\ntitle: T\n---\nbody")
    (tmp_path / "kb" / "b.txt").write_text("no")
    assert one(files.read_corpus(spark, str(tmp_path / "kb")))["title"] == "T"
    (tmp_path / "letters").mkdir()
    letter = {"transfer_id": "9", "target_task": TASK, "target_project": "p"}
    (tmp_path / "letters" / "l").write_text(f"created_at: 2026-08-31T00:00:00+0800\ntransfer: {json.dumps(letter)}\n")
    r = one(files.read_letters(spark, str(tmp_path / "letters")))
    assert (r["transfer_id"], r["created_ts"]) == ("9", 1788105600.0)
    (tmp_path / "log").write_text('{"event_type": "task.created", "task_id": "t", "log_seq": 1}\nbroken\n\n{"event_type": "x", "task_id": "u", "log_seq": 2}\n')
    assert files.read_events(spark, str(tmp_path / "log")).count() == 2 and files.read_events(spark, str(tmp_path / "log"), task_id="u", project_id="").count() == 1
    tables = spark.createDataFrame([(1, "x\n|a|b|\n|---|---|\n|1|2|\ny\n|c|")], "doc_id long, text string")
    assert [(r["table_no"], r["cells"]) for r in files.markdown_tables(tables).orderBy("row_no").collect()] == [(1, ["a", "b"]), (1, ["1", "2"]), (2, ["c"])]


def test_stream_equals_batch(spark, tmp_path):
    rows = [ev("task.created", key="k1", title="T"), ev("task.state_changed", key="k2", to="in_progress"), ev("task.created", key="k1", title="T"), ev("task.created", key="k1", title="other")]
    rows += [ev("task.created", "t2", key="k5", title="U"), ev("agent.heartbeat", at=5), ev("agent.heartbeat", at=5)]
    for i, r in enumerate(rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"log_seq": i} | r) + "\n")
    at = {n: f"{tmp_path}/{n}" for n in ("in", "log", "conflicts", "c1", "view", "board", "c2")}
    board = readmodels.task_board(at["board"], every=2)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.read_log(spark, at["in"], 2), at["log"], at["conflicts"], at["c1"], models=[board]).awaitTermination(120)
    log = spark.read.parquet(at["log"])
    assert log.count() == 5 and one(spark.read.parquet(at["conflicts"]))["payload"]["title"] == "other"
    stream = spark.readStream.schema(EVENT).parquet(f"{at['log']}/*")
    other = readmodels.task_board(at["view"])
    readmodels.refresh(stream, other, at["c2"]).awaitTermination(120)
    key = lambda df: sorted((r["task_id"], r["title"], r["status"]) for r in df.collect())
    assert key(board.read(spark)) == key(other.read(spark)) == key(folds.task_board(log)) == [("t1", "T", "in_progress"), ("t2", "U", "todo")]


def test_windows_and_heartbeats_stream(spark, tmp_path):
    rows = [{"log_seq": i} | ev("agent.heartbeat", at=t) | {"actor": "a"} for i, t in enumerate([0, 10, 70, 3700])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    stream = ingest.read_log(spark, str(tmp_path / "in"))
    for name, df, n in (("beats", ingest.heartbeats(stream).select("log_seq"), 3), ("hours", ingest.windowed_counts(stream), 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "beats" else "complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == n


def test_running_blocks(spark):
    rows = [("a", 5), ("a", 1), ("a", 3), ("a", 8), ("b", 2), (None, 4), (None, 9), ("b", None)]
    df = spark.createDataFrame(rows, "k string, o long")
    got = {(r["k"], r["o"]): r["before"] for r in with_earlier_blocks(df, "k", "o", F.lit(1), block=4).collect()}
    assert got == {("a", 1): 0, ("a", 3): 0, ("a", 5): 2, ("a", 8): 3, ("b", None): 0, ("b", 2): 1, (None, 4): 0, (None, 9): 1}


def test_project_materials_over_blocks(spark):
    rows = [("p", k * 40_000, "x" * 30) for k in range(6)] + [("q", 7, None), ("q", 8, "y" * 200)]
    df = spark.createDataFrame(rows, "project_id string, log_seq long, text string")
    got = {(r["project_id"], r["log_seq"]): r["text"] and len(r["text"]) for r in folds.project_materials(df, cap=100).collect()}
    assert got == {("p", 0): 30, ("p", 40_000): 30, ("p", 80_000): 30, ("p", 120_000): 10, ("q", 7): None, ("q", 8): 100}
