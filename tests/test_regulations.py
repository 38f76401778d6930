"""Hand-made Chinese cases: desensitising, bodies, metadata, numbers and repeals."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import body, masks, metadata
from ledgerloom.operators import clauses, documents


def run(spark, f, *texts, names="abcd"):
    """f over columns of one row of texts."""
    cols = list(names[: len(texts)])
    df = spark.createDataFrame([texts], ", ".join(f"{c} string" for c in cols))
    return df.select(f(*cols).alias("x")).first()["x"]


# --- masks -------------------------------------------------------------------------------------


def test_variants_of_names():
    found = masks.name_variants("星河贸易有限公司/星河")
    assert found == ["星河贸易有限公司", "星河贸易", "星河"]
    placed = masks.name_variants("星河（深圳）实业有限公司")
    assert "星河实业（深圳）有限公司" in placed and "星河实业" in placed and "星河实业有限公司（深圳）" in placed
    assert placed == sorted(placed, key=lambda v: (-len(v), v))
    assert masks.name_variants("Bright Mining Company Limited") == ["Bright Mining Company Limited"]
    assert "Etek" in masks.name_variants("深圳Etek科技有限公司")
    assert masks.name_variants("集团/ /") == ["集团"]


def test_codes_take_the_longest_name_and_keep_words_whole(spark):
    names = spark.createDataFrame([("公司A", "星河贸易有限公司"), ("公司B", "星河贸易投资有限公司"), ("公司C", "ABB"), ("公司D", "VeSync")], "code string, name string")
    rows = [
        ("星河贸易投资有限公司与星河贸易有限公司", "公司B与公司A"), ("星 河贸易", "公司A"), ("NLABB and ABB, ABBs", "NLABB and 公司C, ABBs"),
        ("VeSyncPage", "公司DPage"), (None, None), ("", ""),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id int, text string")
    assert {r["doc_id"]: r["text"] for r in masks.mask_codes(docs, names).collect()} == {k: want for k, (_, want) in enumerate(rows)}
    assert masks.mask_codes(docs.limit(0), names).count() == 0
    with pytest.raises(ValueError, match="more than 3"):
        masks.mask_codes(docs, names, most=3)


def test_people_only_behind_labels(spark):
    mask = lambda t: run(spark, masks.mask_people, t)
    assert mask("联系人：张三，电话") == "联系人：[姓名]，电话"
    assert mask("负责人 李小明。") == "负责人：[姓名]。"
    assert mask("负责人：银行") == "负责人：银行"  # no name
    assert mask("联系人：王中心") == "联系人：王中心"  # a character that names do not have
    assert mask("张三来了") == "张三来了"


def test_rosters_boilerplate_and_marks(spark):
    assert run(spark, masks.hide_rosters, "服务客户：甲乙丙公司、丁戊己公司、庚辛壬公司、子丑寅公司、卯辰巳公司。后文") == "服务客户：[客户名单]。后文"
    assert run(spark, masks.hide_rosters, "客户：甲、乙。") == "客户：甲、乙。"
    assert run(spark, masks.hide_rosters, "客户：甲乙丙丁戊己庚辛壬癸甲乙丙丁戊己庚辛壬癸甲乙、丙") == "客户：甲乙丙丁戊己庚辛壬癸甲乙丙丁戊己庚辛壬癸甲乙、丙"
    assert run(spark, masks.strip_boilerplate, "正文。版权所有，不得转载。后文 © 2024 某所 中国印刷完") == "正文。后文 "  # the printer's line goes first, then all behind the year
    assert run(spark, masks.merge_marks, "[事务所][事务所][姓名]x[姓名]") == "[姓名]x[姓名]"
    assert run(spark, masks.merge_branches, "[事务所] 深圳分公司在") == "[事务所]在"
    watched = lambda c: masks.mask_watched(c, ["John Smith", "张三丰", "张三"])
    assert run(spark, watched, "John   Smith 与张三丰、张三") == "[姓名] 与[姓名]、[姓名]"
    assert run(spark, masks.xml_escape, 'a<b>&"c"') == "a&lt;b&gt;&amp;&quot;c&quot;"
    assert [run(spark, masks.client_of, t) for t in ("备忘录_星河有限公司-20240101", "张三_说明", "星河集团 2024")] == ["星河有限公司", "张三", "星河集团"]


def test_desensitized_chain(spark):
    text = "ReportReport 毕马威 研究院\n联系人：张三 电话 13812345678\n12\n版权所有，不得转载"
    out = run(spark, documents.desensitized, text)
    assert out.startswith("Report [事务所]\n联系人：[姓名] 电话 [手机号]\n") and "版权" not in out
    assert run(spark, documents.desensitized, None) is None and run(spark, documents.desensitized, "") == ""


def test_relabelling_is_a_bijection_that_a_seed_decides(spark):
    docs = spark.createDataFrame([(1, "公司A付给公司B，个人C见证"), (2, "公司B和公司AA"), (3, "无"), (4, None)], "doc_id int, text string")
    labels = masks.relabelled(docs, seed=7)
    pairs = {r["code"]: r["label"] for r in labels.collect()}
    assert pairs.keys() == {"公司A", "公司B", "个人C", "公司AA"} and sorted(pairs.values()) == ["实体A", "实体B", "实体C", "实体D"]
    texts = {r["doc_id"]: r["text"] for r in masks.relabel(docs, labels).collect()}
    assert texts[1] == f"{pairs['公司A']}付给{pairs['公司B']}，{pairs['个人C']}见证" and texts[3] == "无" and len(texts) == 4
    assert any({r["code"]: r["label"] for r in masks.relabelled(docs, seed=s).collect()} != pairs for s in range(3))
    codes = masks.new_codes(spark.createDataFrame([(f"n{i}",) for i in range(30)], "name string"), taken=1)
    assert {r["code"] for r in codes.collect()} == {"公司" + (chr(65 + i) if i < 26 else "A" + chr(39 + i)) for i in range(1, 31)}


def test_generalised_export(spark):
    text = "深圳星河有限公司在德国做光伏，持股51%。Bright Mining Holdings Limited 于2024年3月5日"
    assert run(spark, masks.generalize_all, text) == "[实体]在[属地]做[行业]，持股[控股]。[实体] 于2024年"


# --- bodies ------------------------------------------------------------------------------------


def test_normal_characters(spark):
    assert run(spark, body.normal, "⼈⺠ＡＢ１２：⻓⽂") == "人民AB12:长文"
    for radical, char in zip("".join(body.RADICALS), "".join(body.RADICALS.values())):
        assert unicodedata.name(radical).startswith("CJK RADICAL") and unicodedata.name(char).startswith("CJK UNIFIED")
    assert run(spark, body.normal, None) is None


def test_site_templates(spark):
    assert run(spark, body.strip_page_numbers, "个- 1-人和—2—完 2020-01-02") == "个人和完 2020-01-02"
    page = "标题\n" + "正文内容。" * 30 + "\n热门关键词:企业所得税\n其他"
    assert run(spark, body.cut_footer, page) == "标题\n" + "正文内容。" * 30 + "\n"
    early = "标题\n热门关键词:x\n" + "正文内容。" * 60
    assert run(spark, body.cut_footer, early) == early  # within the first twentieth
    below = page + "\n第一条 有条文"
    assert run(spark, body.cut_footer, below) == below
    lines = "首页 | 政务公开 > 搜索\n发文机关：\n来源:某网\n京ICP备1号\n应当办理备案管理。"
    assert run(spark, body.drop_site_lines, lines) == "发文机关：\n应当办理备案管理。"
    assert run(spark, body.strip_web_prefix, "导航网站纠错财政部 税务总局关于某事的公告") == "财政部 税务总局关于某事的公告"
    kept = "第一条 甲\n国务院令"
    assert run(spark, body.strip_web_prefix, kept) == kept
    assert run(spark, body.canonic, "⾼级\n热门搜索 x\n—3—完") == "高级\n完"


def test_meta_head(spark):
    got = run(spark, body.meta_head, "某办法\n发文机关：\n财政部\n文号：\n财税1号\n正文一\n正文二")
    assert got["meta"] == {"发文机关": "财政部", "文号": "财税1号"} and got["body"] == "正文一\n正文二"
    assert run(spark, body.meta_head, "只有正文")["meta"] == {} and run(spark, body.meta_head, "只有正文")["body"] == "只有正文"


def test_wrapped_lines(spark):
    text = "关于某事的\n规定\n一、第一\n项内容。\n12\n二、依照《条例》\n第七条的规定，\nPart A x\n办理。\n第二章 总则\n第五条 新条"
    assert run(spark, body.unwrapped, text) == ["关于某事的规定", "一、第一项内容。", "二、依照《条例》第七条的规定，办理。", "第二章 总则", "第五条 新条"]
    assert run(spark, body.unwrapped, None) is None and run(spark, body.unwrapped, "") == []


def test_headings_go_once(spark):
    strip = lambda b, t="关于商品储备的公告", n="财政部公告2023年第48号": run(spark, body.strip_heading, b, t, n)
    assert strip("财政部关于商品储备的公告\n财政部 税务总局公告2023年第48号\n为继续支持，现公告如下") == "为继续支持，现公告如下"
    assert strip("关于商品储备的公告 公告2023年第48号 各省：\n正文") == " 各省：\n正文"
    assert strip("正文先行\n提到2022年第48号\n关于商品储备的公告另见") == "正文先行\n提到2022年第48号\n另见"
    assert strip("x\n" * 13 + "关于商品储备的公告").endswith("关于商品储备的公告")
    assert strip("正文", "", "无号") == "正文"


def test_annexes(spark):
    got = run(spark, body.split_annex, "正文一\n（注：参见\n附表 ）后文\n附件1\n第一条 " + "内容" * 40 + "\n第二条 " + "内容" * 40 + "\n第三条 " + "内容" * 40)
    assert got["body"] == "正文一\n（注：参见\n附表 ）后文" and got["annex"].startswith("附件1\n") and got["kind"] == "doc"
    assert run(spark, body.annex_kind, "附件\n第一章 总则\n填写说明") == "doc"
    assert run(spark, body.annex_kind, "附件1 申报表\n一、填写") == "table"
    assert run(spark, body.annex_kind, "某某产业指导目录\n" + "一、" + "长" * 100 + "二、" + "长" * 100 + "三、" + "长" * 100) == "table"
    assert run(spark, body.annex_kind, "附件\n" + "一、" + "长" * 100 + "二、" + "长" * 100 + "三、" + "长" * 100) == "doc"
    assert run(spark, body.split_annex, "没有附件")["kind"] == ""
    whole = "现将有关事项通知如下：" + "字" * 400 + "\n现将职责公告如下：一、甲"
    opened = run(spark, body.split_at_opening, whole)
    assert opened["annex"] == "现将职责公告如下：一、甲" and opened["body"] + opened["annex"] == whole
    assert run(spark, body.split_at_opening, "现将通知如下")["annex"] == ""


# --- metadata ----------------------------------------------------------------------------------


def test_numbers_and_titles_of_names(spark):
    number = lambda t: run(spark, metadata.number_of_name, t)
    assert number("0 财税[2001]10号 关于某事的通知") == "财税[2001]10号"
    assert number("国家税务总局公告2023年第35号 某事") == "国家税务总局公告2023年第35号"
    assert number("横琴财政局文件2024年第2号x") == "横琴财政局文件2024年第2号"
    assert number("3 申请指引") == "申请指引"
    assert run(spark, metadata.topic, "关于延续实施养老服务税费优惠政策的公告") == "养老服务税费优惠"
    assert run(spark, metadata.topic, "函") == ""
    assert run(spark, metadata.short_title, "关于个人所得税征收管理若干问题的公告（2018年修正）") == "个人所得税征收管理"
    assert run(spark, metadata.short_title, "关于发布《某办法》的公告") == "某办法"
    assert run(spark, metadata.short_title, "") == ""


def test_offices_and_places(spark):
    assert run(spark, metadata.sheet_office, "Status\nIssuing Body*\n深圳市\n\n税务局\nYear*\n2020") == "深圳市 税务局"
    assert run(spark, metadata.sheet_office, "Status\nx") == ""
    assert run(spark, metadata.tail_office, "正文\n附注\n深圳市税务局\n财政部\n2020年5月13日\n抄送") == "深圳市税务局 财政部"
    assert run(spark, metadata.tail_office, "正文") == ""
    place = lambda *a: run(spark, metadata.place, *a)
    assert place("河套深圳园区办法", "x", "", "/a/广东/b") == "河套"
    assert place("某通知", "1 广东省惠州市细则.pdf", "", "/深圳/x") == "惠州市"
    assert place("某通知", "x.pdf", "", "/广东/深圳/x") == "深圳市"
    assert place("某通知", "x.pdf", "", "/其他") == ""


def test_subjects_and_status(spark):
    assert run(spark, metadata.subjects, "铁路与股权代持", "地方教育附加办法") == ["铁路", "股权代持", "地方教育附加"]
    covered = lambda t, s: spark.createDataFrame([(t, s)], "t string, s array<string>").select(metadata.topic_covered("t", F.col("s")).alias("x")).first()["x"]
    assert covered("铁路、运输", ["铁路"]) and covered("", []) and not covered("养老", ["铁路"])
    status = lambda t, s: spark.createDataFrame([(t, s)], "t string, s array<string>").select(metadata.status("t", F.col("s")).alias("x")).first()["x"]
    clause = "四、本公告自发布之日起施行。"
    assert status(clause, ["四、本公告自发布之日起施行"]) == "已作废"
    longer = "四、本公告自发布之日起施行，此前规定与本公告不一致的以本公告为准。"
    assert status(longer + "财政部2020年5月13日", [longer]) == "已作废"
    assert status(clause, ["三、其他。四、本公告自发布之日起施行。五、"]) == "已作废"
    assert status(clause, ["自发布之日"]) == "部分作废" and status(clause, ["别的"]) == "有效" and status(clause, []) == "有效"


def test_tags(spark):
    line = "- 正文〔仅适用：铁路〕〔财税[2001]10号 第三条〕"
    assert run(spark, metadata.tail_number, line) == "财税[2001]10号" and run(spark, metadata.event_tag, line) == "铁路"
    assert run(spark, metadata.tail_number, "- x〔税种依文件标题〕") is None and run(spark, metadata.event_tag, "- x") is None
    assert run(spark, metadata.tail_number, "- x〔公告2012年第29号 前言】****乱〕") == "公告2012年第29号"
    assert run(spark, metadata.without_status, "- 正文 「已作废」") == "- 正文"


# --- numbers and repeals -----------------------------------------------------------------------


def test_every_form_of_a_number(spark):
    numbers = lambda t: run(spark, clauses.document_numbers, t)
    assert numbers("海关总署令第153号") == ["海关总署|令|153", "~|令|153"]
    assert "税务总局|年号|2018|31" in numbers("国家税务总局公告2018年第31号")
    assert "发改委|令|34" in numbers("发展和改革委员会2016年第34号令") and "~|年号|2016|34" in numbers("发展和改革委员会2016年第34号令")
    assert set(numbers("2018年第31号公告")) == {"|年号|2018|31", "~|年号|2018|31"}
    assert numbers("国税发〔00〕195号")[0] == "国税发|年号|2000|195" and numbers("没有") == []


REPEALS = [
    ("依据《乙办法规定》，现废止", []),
    ("除《己办法规定》外，其他规定废止", []),
    ("《辛办法规定》的附件废止", []),
    ("根据《癸办法规定》，现予废止《子办法规定》", []),
    ("《丁办法规定》停止执行", ["丁办法规定"]),
    ("《丁办法规定》失效", []),
    ("《甲办法规定》和《戊办法规定》同时废止", ["戊办法规定", "甲办法规定"]),
    ("《关于废止某规定的决定》自公布之日起施行", []),
    ("《甲办法规定》中有关内容废止", []),
    ("第三十二条 本办法自发布起施行，《旧办法规定》（财税〔2009〕13号）同时废止", ["旧办法规定"]),
    ("《令的办法》公布施行，《旧办法规定》废止", ["旧办法规定"]),
    ("海关总署令第153号公布的《老办法规定》废止。本条第二款不变", ["老办法规定"]),
    ("【某文 第一条】《丁办法规定》停止施行〔仅适用：x〕《寅办法规定》废止", ["丁办法规定"]),
]


def test_repeal_sentences(spark):
    docs = spark.createDataFrame([(str(k), t) for k, (t, _) in enumerate(REPEALS)], "doc string, text string")
    rows = clauses.repeals(docs).collect()
    assert {k: sorted(r["title"] for r in rows if r["doc"] == str(k)) for k in range(len(REPEALS))} == {k: want for k, (_, want) in enumerate(REPEALS)}
    numbers = {r["title"]: set(r["nums"]) for r in rows if r["nums"]}
    assert numbers == {"旧办法规定": {"财税|年号|2009|13", "~|年号|2009|13"}, "老办法规定": {"海关总署|令|153", "~|令|153"}}


def test_repeals_resolve_step_by_step(spark):
    catalog = spark.createDataFrame(
        [("甲规定", ["财税|年号|2009|13"]), ("乙规定", ["财税|年号|2009|14"]), ("旧事项若干具体规则", []), ("旧事项其他具体规则", ["财税|年号|2001|1"])], "doc string, nums array<string>"
    )
    found = spark.createDataFrame(
        [
            ("x", "别名", ["财税|年号|2009|13"]), ("x", "乙规定", []), ("x", "乙规定一", ["财税|年号|2009|99"]), ("x", "关于旧事项若干具体规则的通知", []),
            ("x", "关于旧事项其他具体规则的通知", ["~|年号|2002|9"]), ("乙规定", "乙规定", []), ("y", "乙规定", ["财税|年号|2000|1"]),
        ],
        "doc string, title string, nums array<string>",
    )
    got = {(r["doc"], r["title"]): (r["target"], r["why"]) for r in clauses.resolve_repeals(found, catalog).collect()}
    assert got[("x", "别名")] == ("甲规定", "number") and got[("x", "乙规定")] == ("乙规定", "title")
    assert got[("x", "乙规定一")] == (None, None) and got[("乙规定", "乙规定")] == (None, None)
    assert got[("x", "关于旧事项若干具体规则的通知")] == ("旧事项若干具体规则", "core")
    assert got[("x", "关于旧事项其他具体规则的通知")] == (None, "core, but another number")
    assert got[("y", "乙规定")] == (None, "title, but another number")


def test_pieces_before_the_first_mark_stay_apart(spark):
    docs = spark.createDataFrame([(1, "总则。\n说明。\n第一条 甲\n续行\n（一）乙"), (2, "只有前言"), (3, "")], "doc_id long, text string")
    rows = clauses.cut(docs).orderBy("doc_id", "clause_no").collect()
    assert [(r["doc_id"], r["clause_no"], r["unit"], r["text"]) for r in rows] == [
        (1, 0, "", "总则。"), (1, 1, "", "说明。"), (1, 2, "第一条", "第一条 甲续行"), (1, 3, "第一条-（一）", "（一）乙"), (2, 0, "", "只有前言"),
    ]


def test_titles_of_new_groups(spark):
    groups = spark.createDataFrame([(1, "铁路（甲号）"), (2, "邮政（甲号）（乙号）"), (3, "其他事（丙号）")], "group_id int, title string")
    new = spark.createDataFrame([(1, "丙号", "x"), (2, "甲号", "x"), (3, "丁号", "事"), (4, "丁号", None), (5, None, "事"), (6, None, None)], "clause_id int, number string, event string")
    got = {r["clause_id"]: r["title"] for r in clauses.group_titles(new, groups).collect()}
    assert got == {1: "其他事（丙号）", 2: "铁路（甲号）", 3: "事（丁号）", 4: "丁号", 5: "事", 6: "其他"}


def test_spellings_are_patterns_of_java_too(spark):
    for pattern in [*masks.BOILERPLATE, metadata.NAME_NUMBER, body.ANNEX_LINE]:
        spark.createDataFrame([("x",)], "t string").select(F.regexp_replace("t", "(?dU)" + pattern, "")).collect()
        re.compile(pattern.replace(r"\z", r"\Z"))


def test_audit_of_what_still_leaks(spark):
    text = "type: 筹划案\n深圳星河有限公司与公司A有限公司 Bright Star Limited 和 The Group，1,200万元，a@bb.cn，经理：张三丰，顾问王五，经理：银行"
    docs = spark.createDataFrame([(1, text), (2, "没有发现"), (3, None)], "doc_id int, text string")
    rows = documents.audit(docs, watched=["王五"], masked=["Kept Limited"]).collect()
    assert {r["doc_id"] for r in rows} == {1} and all(r["is_client"] for r in rows)
    found = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        found.setdefault(r["kind"], []).append(r["value"])
    assert found == {"中文公司名": ["深圳星河有限公司"], "英文公司名": ["Bright Star Limited"], "精确金额": ["1,200万元"], "邮箱": ["a@bb.cn"], "人名": ["王五"], "可能人名": ["张三丰"]}


def test_json_or_raw(spark):
    from ledgerloom.functions import text as tx

    rows = spark.createDataFrame([('{"a": 1}',), ("plain",), (None,), ("{broken",)], "t string").select(tx.json_or_raw("t", "a int").alias("x")).collect()
    assert [(r["x"]["value"] and r["x"]["value"]["a"], r["x"]["raw"]) for r in rows] == [(1, None), (None, "plain"), (None, None), (None, "{broken")]


def test_whole_table_against_plain_python(spark, tiny):
    """The queries that SQL cannot say, row by row in plain Python over the whole table."""
    from ledgerloom.functions import text as tx
    from ledgerloom.plans import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}

    def cleaned(t):
        t = re.sub(r"([A-Za-z]{4,})\1", r"\1", t)
        for pattern, by in tx.REDACTIONS:
            t = re.sub(pattern, by.replace("$1", r"\1"), t, flags=re.ASCII)
        t = re.sub(tx.NOISE_LINE, "", t)
        t = re.sub("[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", t))
        lines = t.split("\n")
        short = [x.strip(" ") for x in lines if x.strip(" ") and len(x.strip(" ")) <= 80]
        often = {x for x in short if short.count(x) >= 5}
        return "\n".join("" if x.strip(" ") in often else x for x in lines)

    doubled = {r["doc_id"]: r["text"] for r in QUERIES["doubled_word_collapse"](spark, tiny).collect()}
    assert doubled == {d: re.sub(r"([A-Za-z]{4,})\1", r"\1", t) for d, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in QUERIES["clean_documents"](spark, tiny).collect()} == {d: cleaned(t) for d, t in texts.items()}


def test_cleaning_names_each_step_once(spark):
    """Spark repeats a named expression, in a lambda for each line; so each text is cut and searched once only."""
    text = "\n".join(f"line {k} of 555 bywords someone@example.org goodgood" for k in range(3000)) + "\nHeader" * 5
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    for clean in (documents.clean, documents.desensitized):
        df = docs.select("doc_id", clean("text").alias("text"))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"([A-Za-z]{4,})\1") == 1 and plan.count("split(") <= 2
        got = {r["doc_id"]: r["text"] for r in df.collect()}
        assert got[2] is None and got[3] == ""
        assert got[1].split("\n")[7] == "line 7 of 555 bywords [邮箱] good" and not any(got[1].split("\n")[3000:])
