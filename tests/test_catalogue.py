"""Hand-made cases of catalogues, guides, groups, batches and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import catalogue as cat


def lines(spark, *texts):
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id int, line_no int, line string")


def test_rows_of_a_catalogue(spark):
    rows = cat.catalogue_rows(
        lines(
            spark, "页眉", "全国鼓励外商投资产业目录", "一、农业", "（一）种植", "1.木本油料", "0.3 毫米的板", "2．茶叶", "续行", "注：说明", "二、渔业", "3.鱼",
            "山西省（北部）", "1.零部件", "20.跳号", "中西部地区外商投资优势产业目录", "1.别的",
        )
    )
    got = [tuple(r) for r in rows.orderBy("line_no").select("num", "text", "part", "province", "section", "subsection").collect()]
    whole, west = "全国鼓励外商投资产业目录", "中西部地区外商投资优势产业目录"
    assert got == [
        ("1", "木本油料0.3 毫米的板", whole, "", "一、农业", "（一）种植"), ("2", "茶叶续行", whole, "", "一、农业", "（一）种植"),
        ("3", "鱼", whole, "", "二、渔业", ""), ("1", "零部件20.跳号", whole, "山西省（北部）", "", ""), ("1", "别的", west, "", "", ""),
    ]
    text = [r["l"] for r in rows.orderBy("line_no").select(cat.catalogue_line().alias("l")).collect()]
    assert text[0] == "- 全国鼓励外商投资产业目录 · 一、农业｜（一）种植｜1.木本油料0.3 毫米的板" and text[3] == "- 山西省鼓励外商投资优势产业 · 1.零部件20.跳号"
    assert {r["part"]: r["n"] for r in cat.by_part(rows).collect()} == {whole: 4, west: 1}
    assert cat.catalogue_rows(lines(spark).limit(0)).count() == 0


def test_headings_of_a_guide(spark):
    pages = []
    for page in range(12):
        pages += [("g", page, 0, 10.0, "Guide 2026"), ("g", page, 1, 14.0 if page else 40.0, "France" if page % 2 else "Spain"), ("g", page, 2, 9.0, "text"), ("g", page, 3, 12.0, str(page))]
    rows = spark.createDataFrame(pages + [("h", 0, 0, 9.0, "nothing")], "doc string, page int, line_no int, size double, text string")
    lexicon = spark.createDataFrame([("France",), ("Spain",)], "text string")
    assert {r["text"] for r in cat.running_headers(rows).collect()} == {"Guide 2026", "text"}
    sizes = cat.heading_size(rows, lexicon)
    assert {r["doc"]: r["size"] for r in sizes.collect()} == {"g": 14.0, "h": 13.0}
    assert cat.headings(rows, lexicon, sizes).count() == 12


def test_sections_that_follow_each_other_merge(spark):
    sections = spark.createDataFrame(
        [("g", 0, "A", ["x" * 300]), ("g", 1, "A", ["y" * 200]), ("g", 2, "B", ["z"]), ("g", 3, "A", ["w" * 400])], "doc string, pos int, name string, paragraphs array<string>"
    )
    got = [(r["name"], len(r["paragraphs"])) for r in cat.merge_sections(sections).orderBy("pos").collect()]
    assert got == [("A", 2), ("A", 1)]


def test_counters(spark):
    docs = spark.createDataFrame([("n1", "关于甲事的通知"), ("n1", "关于乙事的通知"), ("n2", "丙")], "number string, name string")
    assert {r["display"] for r in cat.ambiguous_numbers(docs).collect()} == {"n1·甲事", "n1·乙事", "n2"}
    clauses = spark.createDataFrame(
        [("d", "有效", ["铁路"], True, ["增值税"], ["定义", "程序"]), ("d", "已作废", [], True, ["增值税"], ["定义"]), ("e", "部分作废", ["铁路", "核工业"], False, [], ["定义"])],
        "doc string, status string, subjects array<string>, has_annex boolean, taxes array<string>, rules array<string>",
    )
    assert tuple(cat.index_totals(clauses).first()) == (2, 3, 2, 1, 2, 2)
    assert tuple(cat.index_totals(clauses.limit(0)).first()) == (0, 0, 0, 0, 0, 0)


def test_groups(spark):
    files = spark.createDataFrame(
        [("t", "r", k, x) for k, x in enumerate(["# 头", "## 甲", "- 一 内容", "- 二", "## 空", "", "## 乙 ", "- 三"])], "tax string, rule string, line_no int, line string"
    )
    groups = cat.collect_groups(files)
    assert [(r["title"], r["n"], r["sample"], r["lines"]) for r in groups.orderBy("title").collect()] == [("乙", 1, "三", ["- 三"]), ("甲", 2, "一 内容", ["- 一 内容", "- 二"])]
    mapping = spark.createDataFrame([("t", "r", "甲", "主题")], "tax string, rule string, title string, topic string")
    sizes = cat.topics_by_size(cat.with_topics(groups, mapping)).collect()
    assert [tuple(r) for r in sizes] == [("t", "主题", 2), ("t", "其他", 1)]
    assert groups.select(cat.group_id("tax", "rule", "title").alias("i")).orderBy("i").first()["i"] == "t|r|乙"
    pruned = cat.prune_groups(files.select(F.lit("f").alias("file"), "line_no", "line")).orderBy("line_no").collect()
    assert [r["line"] for r in pruned] == ["# 头", "## 甲", "- 一 内容", "- 二", "## 乙 ", "- 三"]


def test_joins_and_maps(spark):
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "doc string")
    assert [r["doc"] for r in cat.untaxed(names("a", "b", "c"), names("a"), names("b")).collect()] == ["c"]
    maps = spark.createDataFrame([("i", 1, "old", 1), ("i", 2, "new", None), ("j", 1, "x", 3)], "id string, batch int, label string, n int")
    assert {r["id"]: (r["label"], r["n"]) for r in cat.label_maps(maps).collect()} == {"i": ("new", None), "j": ("x", 3)}


def test_batches_and_chunks(spark):
    files = spark.createDataFrame([("g", n, s) for n, s in [("a", 100), ("b", 60), ("c", 50), ("d", 200), ("e", 10), ("f", 150)]], "group string, name string, n int")
    got = [r["files"] for r in cat.greedy_batches(files).orderBy("batch").collect()]
    assert got == [["d"], ["f"], ["a"], ["b", "c", "e"]]
    rows = spark.createDataFrame([(3 * k,) for k in range(500)], "id long")
    counts = cat.chunks_of(rows, "id").groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("lo")).orderBy("chunk").collect()
    assert [(r["chunk"], r["n"], r["lo"]) for r in counts] == [(0, 165, 0), (1, 165, 495), (2, 165, 990), (3, 5, 1485)]


def test_stamps(spark):
    labels = spark.createDataFrame([("b", "1", "x"), ("b", "2", "y"), ("c", "1", None)], "batch string, id string, label string")
    sources = spark.createDataFrame([("b", "f1"), ("b", "f2")], "batch string, name string")
    none = spark.createDataFrame([], "batch string, stamp string")
    first = cat.staleness(labels, sources, none)
    assert all(r["stale"] and len(r["stamp"]) == 12 for r in first.collect()) and first.count() == 2
    again = cat.staleness(labels.orderBy(F.desc("id")).repartition(3), sources, first.select("batch", "stamp"))
    assert not any(r["stale"] for r in again.collect())
    changed = cat.staleness(labels, sources.limit(1), first.select("batch", "stamp"))
    assert {r["batch"] for r in changed.where("stale").collect()} == {"b"}


def test_answers_of_a_ranking_model(spark):
    answers = spark.createDataFrame(
        [(1, 'so [{"i":0,"s":2},{"i":2,"s":9},{"i":7,"s":10},{"i":0,"s":8}] ok', 5), (2, "**[3]** 8\n**[1]** 10 ", 5), (3, "no idea", 2), (4, None, 1)], "query_id int, answer string, n int"
    )
    got = {}
    for r in cat.rerank_answers(answers).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["candidate"], r["score"]))
    assert got == {1: [(2, 9.0), (0, 8.0)], 2: [(1, 10.0), (3, 8.0)], 3: [(0, None), (1, None)], 4: [(0, None)]}


def test_manifests(spark):
    text = '{"version":"1.3","knowledge":{"version":"9","base":"8","url":"u","total_after":3,"full":{"url":"f"}}}'
    rows = cat.manifest_packs(spark.createDataFrame([(text,), ("broken",)], "text string")).collect()
    assert [tuple(r) for r in rows] == [("1.3", "cases", "9", "8", "u", "f", 3)]


def test_status_follows_the_source(spark):
    source = spark.createDataFrame([("f", 0, "- 甲 「已作废」"), ("f", 1, "- 甲"), ("f", 2, "- 乙")], "file string, pos int, line string")
    own = spark.createDataFrame([("f", 5, "- 甲"), ("f", 6, "- 甲"), ("f", 7, "- 丙")], "file string, pos int, line string")
    got = [(r["line"], r["changed"]) for r in cat.reconcile_status(source, own).orderBy("pos").collect()]
    assert got == [("- 甲 「已作废」", True), ("- 甲", False), ("- 丙", False)]


def test_similar_texts(spark):
    rows = [("一份文件的正文内容在这里", "一份文件的 正文内容在这里了", True), ("完全不同的甲乙丙丁", "毫无关系的子丑寅卯", False), ("", "x", False), ("ab", "ab", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").select(cat.similar_enough("a", "b").alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_delivery(spark, tmp_path):
    from ledgerloom.operators import clauses, delivery

    rows = [("增值税", "a/b", k, x) for k, x in enumerate(["# 题", "## 组", "- 甲〔仅适用：旧办法〕", "- 乙〔仅适用：新办法〕", ""])]
    rows += [("增值税", "a:b", 0, "- 丙"), ("契税", "空", 0, "- 丁〔仅适用：旧办法〕")]
    files = spark.createDataFrame(rows, "tax string, topic string, line_no int, line string")
    repealed = spark.createDataFrame([("旧办法",)], "doc string")
    out = delivery.deliveries(files, repealed)
    got = {r["name"]: (r["text"], r["n_clauses"]) for r in out.collect()}
    assert got == {
        "a_b": ("---\ntitle: a/b\ntype: 法规\ntax: 增值税\ntopic: a/b\n---\n\n## 组\n- 乙〔仅适用：新办法〕\n", 1),
        "a_b（2）": ("---\ntitle: a:b\ntype: 法规\ntax: 增值税\ntopic: a:b\n---\n\n- 丙\n", 1),
    }
    assert tuple(delivery.lost_clauses(files, repealed, out).first()) == (4, 2, 2)
    path = str(tmp_path / "out")
    delivery.write_delivery(out.withColumn("tax", F.lit("旧")), path)
    delivery.write_delivery(out, path)
    assert {r["tax"] for r in spark.read.json(path).select("tax").collect()} == {"增值税"}
    both = clauses.union_batches([files.limit(1), files.limit(1).drop("line")])
    assert sorted((r["batch"], r["line"]) for r in both.collect()) == [(0, "# 题"), (1, None)] or both.count() == 2


def test_clause_files_and_sinks(spark, tmp_path):
    from ledgerloom.sources import files

    for batch, kind, name, text in [("b1", "按税种", "增值税", "# x\n- 甲\n- 乙"), ("b1", "按事件", "铁路", "- 丙"), ("_old", "按税种", "增值税", "- 旧"), (".x", "按税种", "契税", "- 隐")]:
        folder = tmp_path / "in" / batch / kind
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.md").write_text(text, encoding="utf-8")
    found = files.read_clauses(spark, str(tmp_path / "in"))
    assert sorted(r["line"] for r in found.collect()) == sorted(["- 甲", "- 乙", "- 丙"])
    assert [r["line"] for r in files.read_clauses(spark, str(tmp_path / "in"), taxes=[], events=["铁路"]).collect()] == ["- 丙"]
    clauses = spark.createDataFrame([("1", "第一条", "短"), ("2", "", "太短"), ("3", None, "没有条号但是够长的一段文字")], "id string, unit string, text string")
    files.dump_clauses(clauses, str(tmp_path / "dump"))
    assert {r["id"] for r in spark.read.json(str(tmp_path / "dump")).collect()} == {"1", "3"}
    vectors = spark.createDataFrame([(1, "zh"), (2, "en")], "vec_id int, lang string")
    files.write_vectors(vectors, str(tmp_path / "vec"))
    files.write_vectors(vectors, str(tmp_path / "vec"))
    assert files.read_vectors(spark, str(tmp_path / "vec")).count() == 2 and files.read_vectors(spark, str(tmp_path / "vec"), "en").first()["vec_id"] == 2
    (tmp_path / "led").mkdir()
    (tmp_path / "led" / "a.jsonl").write_text('{"agent": "x", "n": 1}\n{"agent": "y", "n": 2}\nbroken')
    assert files.read_ledgers(spark, [str(tmp_path / "led")], "y").first()["n"] == 2
    shard = spark.createDataFrame([(("f", "t"),)], "meta struct<file: string, title: string>")
    assert files.check_public(shard) is shard
    import pytest

    with pytest.raises(ValueError, match="secret"):
        files.check_public(spark.createDataFrame([(("f", "s"),)], "meta struct<file: string, secret: string>"))
