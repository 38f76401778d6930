"""Queries over Chinese fixtures made from the tables: names, numbers, repeals, metadata, catalogues.

The tables hold no Chinese, so each query puts a document's number into hand-made forms. The SQL says
what must come out of each form, and does not repeat the patterns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import body, masks, metadata
from ..operators import catalogue as cat
from ..operators import clauses, retrieval, teams
from ..sources import files
from ..sources.tables import table
from .catalog import query

def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _form(cases: list, by: int | None = None):
    """One of several columns, by the document's number."""
    out = F.lit(None)
    for k, c in enumerate(cases):
        out = F.when(F.col("doc_id") % len(cases) == k, c).otherwise(out)
    return out


def _sql_form(cases: list[str]) -> str:
    return "CASE doc_id % " + str(len(cases)) + " " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


def _filled(pattern: str):
    """A text with the document's number in place of #."""
    parts = pattern.split("#")
    cols = [F.lit(parts[0])]
    for p in parts[1:]:
        cols += [F.col("doc_id").cast("string"), F.lit(p)]
    return F.concat(*cols)


def _sql_filled(pattern: str) -> str:
    return " || CAST(doc_id AS VARCHAR) || ".join(f"'{p}'" for p in pattern.split("#"))


def _expected(pairs: list[tuple[str, str]], name: str) -> str:
    return f"SELECT doc_id, {_sql_form([_sql_filled(want) for _, want in pairs])} AS {name} FROM documents"


def _made(spark, sf_dir, pairs: list[tuple[str, str]]):
    return _docs(spark, sf_dir).select("doc_id", _form([_filled(given) for given, _ in pairs]).alias("t"))


#: What a sentence repeals, empty for nothing.
REPEALS = [
    ("依据《第#号的规定》，现废止", ""), ("除《第#号的规定》外，其他规定废止", ""), ("《第#号的规定》的附件废止", ""), ("《第#号的规定》停止执行", "第#号的规定"),
    ("根据《第#号的规定》，现予废止《旧办法#》", ""), ("《第#号的规定》失效", ""), ("《第#号的规定》（财税〔2009〕#号）同时废止", "第#号的规定"),
    ("《关于废止第#号的决定》自公布之日起施行", ""), ("第三条 本办法自发布起施行，《第#号的规定》停止施行", "第#号的规定"), ("《第#号的规定》中有关内容废止", ""),
    ("海关总署令第#号公布的《第#号的规定》废止", "第#号的规定"),
]


@query(f"SELECT doc_id, title FROM ({_expected(REPEALS, 'title')}) WHERE title <> ''")
def repeal_sentences(spark, sf_dir):
    docs = _made(spark, sf_dir, REPEALS).select(F.col("doc_id").cast("string").alias("doc"), F.col("t").alias("text"))
    return clauses.repeals(docs).select(F.col("doc").cast("bigint").alias("doc_id"), "title")


NUMBERS = [
    ("海关总署令第#号", "~|令|#,海关总署|令|#"), ("国家税务总局公告2018年第#号", "~|年号|2018|#,税务总局|年号|2018|#"), ("2018年第#号公告", "|年号|2018|#,~|年号|2018|#"),
    ("国家发展和改革委员会2016年第#号令", "~|年号|2016|#,发改委|令|#"), ("财税〔09〕#号", "~|年号|2009|#,财税|年号|2009|#"), ("（2017年第#号）", "~|年号|2017|#"), ("没有号", ""),
]


@query(_expected(NUMBERS, "numbers"))
def document_numbers(spark, sf_dir):
    numbers = F.array_join(F.array_sort(clauses.document_numbers(F.col("t"))), ",")
    return _made(spark, sf_dir, NUMBERS).select("doc_id", numbers.alias("numbers"))


NAME_NUMBERS = [
    ("0 财税[2001]#号 关于某事的通知", "财税[2001]#号"), ("国家税务总局公告2023年第#号 某事", "国家税务总局公告2023年第#号"), ("3 申请指引#", "申请指引#"), ("财政局文件2024年第#号x", "财政局文件2024年第#号"),
]


@query(_expected(NAME_NUMBERS, "number"))
def name_numbers(spark, sf_dir):
    return _made(spark, sf_dir, NAME_NUMBERS).select("doc_id", metadata.number_of_name("t").alias("number"))


TITLES = [
    ("关于延续实施第#类服务税费优惠政策的公告", "第#类服务税费优惠"), ("关于第#号征收管理若干问题的公告（2018年修正）", "第#号征收管理"), ("关于发布《办法#》的公告", "办法#"), ("第#号决定", "第#号决定"),
]
SHORT = [("", "第#类服务税费优惠"), ("", "第#号征收管理"), ("", "办法#"), ("", "第#号决定")]
TOPICS = [("", "第#类服务税费优惠"), ("", "第#号征收管理若干问题的公告（2018年修正）"), ("", "发布《办法#》"), ("", "第#号决定")]


@query(f"SELECT doc_id, short_title, topic FROM ({_expected([(a, b) for (a, _), (_, b) in zip(TITLES, SHORT)], 'short_title')}) JOIN ({_expected(TOPICS, 'topic')}) USING (doc_id)")
def short_titles(spark, sf_dir):
    return _made(spark, sf_dir, TITLES).select("doc_id", metadata.short_title("t").alias("short_title"), metadata.topic("t").alias("topic"))


PLACES = [("河套深圳园区办法#", "河套"), ("广东省惠州市第#号", "惠州市"), ("全国通知#", "深圳市"), ("广东省办法#", "广东省")]


@query(_expected(PLACES, "place"))
def places(spark, sf_dir):
    return _made(spark, sf_dir, PLACES).select("doc_id", metadata.place("t", F.lit("x.pdf"), F.lit("财政部"), F.lit("/广东/深圳/x.pdf")).alias("place"))


STRUCK = [("四、第#条自发布之日起施行。", "已作废"), ("自发布之日", "部分作废"), ("别的文字", "有效"), ("三、其他。四、第#条自发布之日起施行。五、", "已作废")]


@query(_expected(STRUCK, "status"))
def clause_status(spark, sf_dir):
    struck = _form([F.array(_filled(given)) for given, _ in STRUCK])
    return _docs(spark, sf_dir).select("doc_id", metadata.status(_filled("四、第#条自发布之日起施行。"), struck).alias("status"))


PEOPLE = [
    ("联系人：张三，第#号", "联系人：[姓名]，第#号"), ("负责人：银行#", "负责人：银行#"), ("张三来了#", "张三来了#"), ("法定代表人 李小明#", "法定代表人：[姓名]#"), ("联系人：王中心#", "联系人：王中心#"),
]


@query(_expected(PEOPLE, "text"))
def people_masked(spark, sf_dir):
    return _made(spark, sf_dir, PEOPLE).select("doc_id", masks.mask_people("t").alias("text"))


COMPANIES = [("星河贸易投资有限公司#", "公司B#"), ("与星 河贸易有限公司#", "与公司A#"), ("NLABB and ABB #", "NLABB and 公司C #"), ("VeSyncPage#", "公司DPage#"), ("无#", "无#")]


@query(_expected(COMPANIES, "text"))
def codes_masked(spark, sf_dir):
    names = [("公司A", "星河贸易有限公司"), ("公司B", "星河贸易投资有限公司"), ("公司C", "ABB"), ("公司D", "VeSync")]
    docs = _made(spark, sf_dir, COMPANIES).withColumnRenamed("t", "text")
    return masks.mask_codes(docs, spark.createDataFrame(names, "code string, name string"))


NOTICES = [
    ("正文#。版权所有，不得转载。", "正文#。"), ("客户：甲公司一、乙公司一、丙公司一、丁公司一、戊公司一、己公司#。后", "客户：[客户名单]。后"), ("客户：甲、乙#。", "客户：甲、乙#。"),
    ("[事务所] 深圳分公司[事务所]#", "[事务所]#"), ("网络中的成员。#", "#"),
]


@query(_expected(NOTICES, "text"))
def notices_stripped(spark, sf_dir):
    text = masks.merge_marks(masks.merge_branches(masks.strip_boilerplate(masks.hide_rosters("t"))))
    return _made(spark, sf_dir, NOTICES).select("doc_id", text.alias("text"))


@query("""SELECT count(DISTINCT code) AS n_codes, count(DISTINCT code) AS n_labels, max(n) AS longest FROM (SELECT '公司' || chr(CAST(65 + doc_id % 26 AS INT)) || CASE WHEN doc_id % 3 = 0 THEN chr(CAST(65 + doc_id % 7 AS INT)) ELSE '' END AS code FROM documents)
  CROSS JOIN (SELECT CASE WHEN count(DISTINCT code) > 26 THEN 4 ELSE 3 END AS n FROM (SELECT '公司' || chr(CAST(65 + doc_id % 26 AS INT)) || CASE WHEN doc_id % 3 = 0 THEN chr(CAST(65 + doc_id % 7 AS INT)) ELSE '' END AS code FROM documents))""")
def relabelled_codes(spark, sf_dir):
    letter = lambda n: F.char(65 + F.col("doc_id") % n)
    code = F.concat(F.lit("公司"), letter(26), F.when(F.col("doc_id") % 3 == 0, letter(7)).otherwise(""))
    labels = masks.relabelled(_docs(spark, sf_dir).select(code.alias("text")), seed=11)
    return labels.agg(F.count_distinct("code").alias("n_codes"), F.count_distinct("label").alias("n_labels"), F.max(F.length("label")).alias("longest"))


NORMAL = [("⼈⺠ＡＢ#", "人民AB#"), ("⻓⽂１２#", "长文12#"), ("ﬁ#", "fi#"), ("平常#", "平常#")]


@query(_expected(NORMAL, "text"))
def normal_characters(spark, sf_dir):
    return _made(spark, sf_dir, NORMAL).select("doc_id", body.normal("t").alias("text"))


SITES = [("标题#\n首页 | 搜索\n粤ICP备#号\n正文", "标题#\n正文"), ("甲-1-乙#", "甲乙#"), ("来源:某网\n发文机关：\n值#", "发文机关:\n值#"), ("第一条 正文#\n当前位置:x", "第一条 正文#\n")]


@query(_expected([(a, b) for a, b in SITES], "text").replace("\n", "' || chr(10) || '"))
def site_lines_dropped(spark, sf_dir):
    return _made(spark, sf_dir, SITES).select("doc_id", body.canonic("t").alias("text"))


WRAPPED = [("关于#的\n规定\n一、第一\n项。\n二、第二", "关于#的规定|一、第一项。|二、第二"), ("依照《条例》\n第七条的#", "依照《条例》第七条的#"), ("第二章 总则\n第五条 #", "第二章 总则|第五条 #"), ("12\n正文#。\n后文", "正文#。|后文")]


@query(_expected(WRAPPED, "text"))
def lines_unwrapped(spark, sf_dir):
    return _made(spark, sf_dir, WRAPPED).select("doc_id", F.array_join(body.unwrapped("t"), "|").alias("text"))


@query(f"""WITH l AS (SELECT doc_id, {_sql_filled("财政部关于第#号事的公告 公告2023年第#号 各省")} AS t FROM documents) SELECT doc_id, ' 各省' AS text FROM l""")
def headings_stripped(spark, sf_dir):
    t = _filled("财政部关于第#号事的公告 公告2023年第#号 各省")
    return _docs(spark, sf_dir).select("doc_id", body.strip_heading(t, _filled("关于第#号事的公告"), _filled("公告2023年第#号")).alias("text"))


ANNEX = [("正文#\n附件1\n第一章 总则", "正文#,doc"), ("正文#\n附表\n申报表", "正文#,table"), ("正文#", "正文#,"), ("正文#（注：\n附表）\n产品进口目录\n一、x", "正文#（注：\n附表）,table")]


@query(f"SELECT doc_id, body, annex_kind FROM (SELECT doc_id, regexp_replace(x, ',[a-z]*$', '') AS body, regexp_extract(x, ',([a-z]*)$', 1) AS annex_kind FROM ({_expected(ANNEX, 'x')}))".replace("\n", "' || chr(10) || '"))
def annexes_split(spark, sf_dir):
    return _made(spark, sf_dir, ANNEX).select("doc_id", body.split_annex("t").alias("x")).select("doc_id", "x.body", F.col("x.kind").alias("annex_kind"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '财政部' ELSE '' END AS office, '正文' || CAST(doc_id AS VARCHAR) AS body FROM documents""")
def meta_heads(spark, sf_dir):
    text = F.when(F.col("doc_id") % 2 == 0, _filled("某办法\n发文机关：\n财政部\n文号：\nx\n正文#")).otherwise(_filled("正文#"))
    rows = _docs(spark, sf_dir).select("doc_id", body.meta_head(text).alias("m"))
    return rows.select("doc_id", F.coalesce(F.try_element_at("m.meta", F.lit("发文机关")), F.lit("")).alias("office"), "m.body")


@query("""SELECT doc_id, regexp_replace(text, '[\\s．.、，,。；;：:（）()【】\\[\\]《》]', '', 'g') AS bare, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM documents""")
def bare_and_escaped(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", body.bare("text").alias("bare"), masks.xml_escape("text").alias("escaped"))


QUERIES_ASKED = [("税#", "为这个句子生成表示以用于检索相关文章：税#"), ("tax #", "Represent this sentence for searching relevant passages:tax #")]


@query(_expected(QUERIES_ASKED, "asked"))
def query_texts(spark, sf_dir):
    return _made(spark, sf_dir, QUERIES_ASKED).select("doc_id", retrieval.query_text("t").alias("asked"))


# --- catalogues, guides and groups ---------------------------------------------------------------

_PAGES = "SELECT lang AS doc, doc_id AS page, generate_subscripts(ls, 1) - 1 AS line_no, 8.0 + (length(unnest(ls)) % 8) AS size, unnest(ls) AS text FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)"


def _page_lines(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("lang").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.withColumn("size", F.lit(8.0) + F.length("text") % 8)


@query(f"SELECT doc, text, count(*) AS n FROM ({_PAGES}) WHERE size <= 11 GROUP BY doc, text HAVING count(*) >= 3")
def running_headers(spark, sf_dir):
    return cat.running_headers(_page_lines(spark, sf_dir), pages=3)


@query(f"""WITH p AS ({_PAGES}), lex AS (SELECT text FROM p GROUP BY text HAVING count(*) >= 2),
  f AS (SELECT doc, page, arg_min(size, line_no) AS size, arg_min(text, line_no) AS text FROM p WHERE size >= 12 AND NOT regexp_full_match(text, '[0-9ivxlIVXLCDM]{{1,6}}') GROUP BY doc, page),
  n AS (SELECT doc, size, count(*) AS n, min(page) AS first_page FROM f WHERE text IN (SELECT text FROM lex) GROUP BY doc, size), b AS (SELECT doc, arg_max(size, (n, -first_page)) AS size FROM n GROUP BY doc)
  SELECT d.doc, CAST(coalesce(b.size, 13.0) AS DOUBLE) AS size FROM (SELECT DISTINCT doc FROM p) d LEFT JOIN b ON b.doc = d.doc OR (b.doc IS NULL AND d.doc IS NULL)""")
def heading_sizes(spark, sf_dir):
    pages = _page_lines(spark, sf_dir)
    lexicon = pages.groupBy("text").agg(F.count("*").alias("n")).where("n >= 2").select("text")
    return cat.heading_size(pages, lexicon)


@query("""WITH d AS (SELECT doc_id, source || '-' || CAST(doc_id % 700 AS VARCHAR) AS number, '关于' || lang || '的通知' AS name FROM documents), n AS (SELECT number, count(*) AS n FROM d GROUP BY number)
  SELECT doc_id, n > 1 AS ambiguous, CASE WHEN n > 1 THEN number || '·' || substring(name, 3, length(name) - 5) ELSE number END AS display FROM d JOIN n USING (number)""")
def ambiguous_numbers(spark, sf_dir):
    name = F.concat(F.lit("关于"), "lang", F.lit("的通知"))
    docs = _docs(spark, sf_dir).select("doc_id", F.concat("source", F.lit("-"), (F.col("doc_id") % 700).cast("string")).alias("number"), name.alias("name"))
    return cat.ambiguous_numbers(docs).select("doc_id", "ambiguous", "display")


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '已作废' WHEN 1 THEN '部分作废' ELSE '有效' END AS status, lang, source, doc_id % 4 = 0 AS annex FROM documents)
  SELECT count(DISTINCT doc_id % 300) AS n_docs, count(*) AS n_clauses, count(*) FILTER (WHERE status <> '有效') AS n_void, count(DISTINCT CASE WHEN annex THEN doc_id % 300 END) AS n_annexes,
    count(DISTINCT source) AS n_subjects, count(DISTINCT (lang, source)) AS n_buckets FROM c""")
def index_totals(spark, sf_dir):
    d = F.col("doc_id")
    status = F.when(d % 5 == 0, "已作废").when(d % 5 == 1, "部分作废").otherwise("有效")
    rows = _docs(spark, sf_dir).select((d % 300).alias("doc"), status.alias("status"), F.array("source").alias("subjects"), (d % 4 == 0).alias("has_annex"), F.array("lang").alias("taxes"), F.array("source").alias("rules"))
    return cat.index_totals(rows)


_GROUPED = """SELECT lang AS tax, substring(source, 1, 4) AS rule, doc_id AS line_no, CASE doc_id % 4 WHEN 0 THEN '## 组' || CAST(doc_id AS VARCHAR) WHEN 3 THEN '' ELSE '- ' || CAST(doc_id AS VARCHAR) || repeat('长', 90) END AS line FROM documents"""
_GROUPS = f"""g AS (SELECT *, count(*) FILTER (WHERE line LIKE '## %') OVER (PARTITION BY tax, rule ORDER BY line_no) AS g FROM ({_GROUPED})),
  c AS (SELECT tax, rule, substring(arg_min(line, line_no), 4) AS title, count(*) FILTER (WHERE line LIKE '- %') AS n, arg_min(substring(line, 3, 80), line_no) FILTER (WHERE line LIKE '- %') AS sample,
    string_agg(line, '|' ORDER BY line_no) FILTER (WHERE line LIKE '- %') AS lines FROM g WHERE g > 0 GROUP BY tax, rule, g)"""


def _grouped(spark, sf_dir):
    d, k = F.col("doc_id"), F.col("doc_id").cast("string")
    line = F.when(d % 4 == 0, F.concat(F.lit("## 组"), k)).when(d % 4 == 3, "").otherwise(F.concat(F.lit("- "), k, F.lit("长" * 90)))
    return _docs(spark, sf_dir).select(F.col("lang").alias("tax"), F.substring("source", 1, 4).alias("rule"), d.alias("line_no"), line.alias("line"))


@query(f"WITH {_GROUPS} SELECT * FROM c WHERE n > 0")
def group_collection(spark, sf_dir):
    groups = cat.collect_groups(_grouped(spark, sf_dir))
    return groups.select("tax", "rule", "title", "n", "sample", F.array_join("lines", "|").alias("lines"))


@query(f"WITH {_GROUPS}, t AS (SELECT tax, CASE WHEN rule = 'src1' OR n % 2 = 0 THEN '主题' || rule ELSE '其他' END AS topic, n FROM c WHERE n > 0) SELECT tax, topic, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY tax, topic")
def topics_by_size(spark, sf_dir):
    groups = cat.collect_groups(_grouped(spark, sf_dir))
    mapping = groups.where("rule = 'src1' OR n % 2 = 0").select("tax", "rule", "title", F.concat(F.lit("主题"), "rule").alias("topic"))
    return cat.topics_by_size(cat.with_topics(groups, mapping))


@query(f"""WITH g AS (SELECT tax || rule AS file, line_no, line, count(*) FILTER (WHERE line LIKE '## %') OVER (PARTITION BY tax, rule ORDER BY line_no) AS g FROM ({_GROUPED})),
  full_groups AS (SELECT DISTINCT file, g FROM g WHERE g = 0 OR line LIKE '- %') SELECT file, line_no, line FROM g SEMI JOIN full_groups USING (file, g)""")
def groups_pruned(spark, sf_dir):
    return cat.prune_groups(_grouped(spark, sf_dir).select(F.concat("tax", "rule").alias("file"), "line_no", "line"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def untaxed_docs(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id")
    return cat.untaxed(docs, docs.where("doc_id % 3 = 0"), docs.where("doc_id % 5 = 0"), "doc_id")


@query("SELECT CAST(doc_id % 400 AS VARCHAR) AS id, arg_max(lang, doc_id) AS label FROM documents GROUP BY ALL")
def label_maps(spark, sf_dir):
    maps = _docs(spark, sf_dir).select((F.col("doc_id") % 400).cast("string").alias("id"), F.col("doc_id").alias("batch"), F.col("lang").alias("label"))
    return cat.label_maps(maps)


@query("SELECT chunk, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 165 AS chunk FROM documents) GROUP BY chunk")
def judging_chunks(spark, sf_dir):
    rows = cat.chunks_of(_docs(spark, sf_dir).select("doc_id"), "doc_id")
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""WITH RECURSIVE f AS (SELECT lang AS g, doc_id, doc_id % 90 + 1 AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 90 DESC, CAST(doc_id AS VARCHAR) DESC) AS r FROM documents WHERE doc_id < 4000000 AND lang IS NOT NULL),
  w AS (SELECT g, r, doc_id, n AS held, 0 AS batch FROM f WHERE r = 1 UNION ALL
    SELECT f.g, f.r, f.doc_id, CASE WHEN w.held + f.n <= 150 THEN w.held + f.n ELSE f.n END, CASE WHEN w.held + f.n <= 150 THEN w.batch ELSE w.batch + 1 END FROM w JOIN f ON f.g = w.g AND f.r = w.r + 1)
  SELECT g, batch, count(*) AS n_files FROM w GROUP BY g, batch""")
def greedy_batches(spark, sf_dir):
    d = F.col("doc_id")
    sized = _docs(spark, sf_dir).where("lang IS NOT NULL").select(F.col("lang").alias("group"), d.cast("string").alias("name"), (d % 90 + 1).cast("int").alias("n"))
    return cat.greedy_batches(sized).select(F.col("group").alias("g"), "batch", F.size("files").cast("bigint").alias("n_files"))


@query("SELECT source AS batch, bool_or(source <> 'src1' AND doc_id % 2 = 0 AND lang IS DISTINCT FROM 'old') AS stale FROM documents GROUP BY source")
def stale_batches(spark, sf_dir):
    labels = _docs(spark, sf_dir).select(F.col("source").alias("batch"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("label"))
    names = labels.select("batch", F.concat(F.lit("f"), "id").alias("name"))
    before = labels.withColumn("label", F.when((F.col("batch") != "src1") & (F.col("id").cast("bigint") % 2 == 0), "old").otherwise(F.col("label")))
    built = cat.staleness(before, names, spark.createDataFrame([], "batch string, stamp string"))
    return cat.staleness(labels, names, built).select("batch", "stale")


@query("""WITH q AS (SELECT doc_id, doc_id % 3 AS form, doc_id % 7 AS a FROM documents) SELECT doc_id AS query_id, 0 AS place, CAST(CASE form WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS INT) AS candidate,
    CASE form WHEN 0 THEN 10.0 + a WHEN 1 THEN 9.0 END AS score FROM q UNION ALL
  SELECT doc_id, 1, CAST(CASE form WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 1 END AS INT), CASE form WHEN 0 THEN CAST(a AS DOUBLE) WHEN 1 THEN CAST(a AS DOUBLE) END FROM q""")
def rerank_answers(spark, sf_dir):
    a = (F.col("doc_id") % 7).cast("string")
    json = F.concat(F.lit('ok [{"i":0,"s":'), a, F.lit('},{"i":2,"s":1'), a, F.lit("}]"))
    answer = F.when(F.col("doc_id") % 3 == 0, json).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("**[3]** 9\n**[1]** "), a, F.lit(" "))).otherwise("none")
    return cat.rerank_answers(_docs(spark, sf_dir).select(F.col("doc_id").alias("query_id"), answer.alias("answer"), F.lit(5).alias("n")), top=2)


@query("""SELECT doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN '- 第' || CAST(doc_id AS VARCHAR) || ' 「已作废」' ELSE '- 第' || CAST(doc_id AS VARCHAR) END AS line, doc_id % 2 = 0 AS changed FROM documents""")
def status_reconciled(spark, sf_dir):
    plain = _filled("- 第#")
    own = _docs(spark, sf_dir).select(F.lit("f").alias("file"), F.col("doc_id").alias("pos"), plain.alias("line"))
    source = _docs(spark, sf_dir).select(F.lit("f").alias("file"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 2 == 0, F.concat(plain, F.lit(" 「已作废」"))).otherwise(plain).alias("line"))
    return cat.reconcile_status(source, own).drop("file")


@query("""WITH r AS (SELECT doc_id, CAST(doc_id % 6 AS INT) AS level, CASE doc_id % 4 WHEN 0 THEN 'pause_project' WHEN 1 THEN 'read_audit' WHEN 2 THEN 'approve_action' ELSE 'other' END AS action FROM documents),
  n AS (SELECT *, CAST(CASE action WHEN 'pause_project' THEN 3 WHEN 'approve_action' THEN 3 WHEN 'read_audit' THEN 0 ELSE 1 END AS INT) AS needed FROM r)
  SELECT doc_id, needed, CASE WHEN level < needed THEN 'denied' WHEN action = 'pause_project' THEN 'approval' ELSE 'allowed' END AS outcome FROM n""")
def permission_checks(spark, sf_dir):
    d = F.col("doc_id")
    action = F.when(d % 4 == 0, "pause_project").when(d % 4 == 1, "read_audit").when(d % 4 == 2, "approve_action").otherwise("other")
    asked = _docs(spark, sf_dir).select("doc_id", (d % 6).cast("int").alias("level"), action.alias("action"))
    return teams.permissions(asked).select("doc_id", "needed", "outcome")


@query("SELECT doc_id, substring(trim(regexp_replace('a/' || source || ' : ' || lang || '?', '[/\\\\:*?\"<>|\\s]+', '_', 'g'), '_'), 1, 80) AS name FROM documents WHERE length(text) >= 12")
def file_names(spark, sf_dir):
    title = F.concat(F.lit("a/"), "source", F.lit(" : "), "lang", F.lit("?"))
    return files.clauses_to_judge(_docs(spark, sf_dir).withColumn("unit", F.lit(""))).select("doc_id", files.file_name(title).alias("name"))


@query("""SELECT 'semantic' AS way, vec_id AS id FROM (SELECT e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY s DESC, e.vec_id LIMIT 5)
  UNION ALL SELECT 'keyword', doc_id FROM (SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS s FROM documents WHERE s >= 2 ORDER BY s DESC, doc_id LIMIT 5)""")
def searches_compared(spark, sf_dir):
    vector = list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])
    return retrieval.compared(table(spark, sf_dir, "embeddings"), _docs(spark, sf_dir), "the", vector).select("way", "id")


@query("SELECT doc_id, (length(text) - length(replace(text, 'ing', ''))) // 3 AS score FROM documents WHERE contains(text, 'ing') ORDER BY score DESC, doc_id DESC LIMIT 5")
def cli_search(spark, sf_dir):
    return retrieval.cli_search(_docs(spark, sf_dir), "ing")


@query("""WITH v AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
  m AS (SELECT label, dim, count(*) AS n, avg(CAST(x AS DOUBLE)) AS mean FROM v GROUP BY label, dim)
  SELECT label, CAST(dim - 1 AS INT) AS dim, n, round(mean / greatest(sqrt(sum(mean * mean) OVER (PARTITION BY label)), 1e-9), 6) + 0.0 AS value FROM m""")
def pooled_vectors(spark, sf_dir):
    pooled = retrieval.pooled(table(spark, sf_dir, "embeddings"), "label")
    return pooled.select("label", "n", F.posexplode("mean").alias("dim", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("""WITH k AS (SELECT CASE WHEN lang IS NULL THEN 'unclassified' WHEN lang = 'en' THEN 'untaxed' WHEN lang = 'de' THEN 'no_subject' ELSE 'other' END AS kind, doc_id AS pos, text FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY pos NULLS LAST, text) AS place, count(*) OVER (PARTITION BY kind) AS total FROM k)
  SELECT kind, CAST(place AS INT) AS place, pos, substring(text, 1, CASE kind WHEN 'unclassified' THEN 90 ELSE 100 END) AS text, total FROM r
  WHERE place <= CASE kind WHEN 'untaxed' THEN 30 WHEN 'no_subject' THEN 40 WHEN 'unclassified' THEN 60 ELSE 0 END""")
def report_samples(spark, sf_dir):
    """What a report shows of documents of three kinds."""
    lang = F.col("lang")
    kind = F.when(lang.isNull(), "unclassified").when(lang == "en", "untaxed").when(lang == "de", "no_subject").otherwise("other")
    return cat.report_samples(_docs(spark, sf_dir).select(kind.alias("kind"), F.col("doc_id").alias("pos"), "text"))
