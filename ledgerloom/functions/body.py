"""Bodies of regulations: normal characters, site templates, wrapped lines, headings and annexes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Radicals that stand for characters and that NFKC leaves alone.
RADICALS = {
    "⺠": "民", "⻛": "风", "⻚": "页", "⻔": "门", "⻄": "西", "⻅": "见", "⻓": "长", "⻝": "食", "⻢": "马", "⻉": "贝", "⻋": "车", "⻘": "青",
    "⻜": "飞", "⻩": "黄", "⻰": "龙", "⻳": "龟", "⺟": "母", "⺘": "手", "⺙": "攴", "⺮": "竹", "⺯": "糸", "⺰": "糸", "⺱": "网", "⺲": "网",
    "⺳": "网", "⺴": "网", "⺵": "网", "⺶": "羊", "⺷": "羊", "⺸": "羊", "⺹": "老", "⺺": "而", "⺻": "耒", "⺼": "肉", "⺽": "肉", "⺾": "艸",
    "⺿": "艸", "⻀": "艸", "⻁": "虎", "⻂": "衣", "⻃": "西", "⻆": "角", "⻈": "言", "⻊": "足", "⻌": "辵", "⻍": "辵", "⻎": "辵", "⻏": "邑",
    "⻐": "酉", "⻑": "長", "⻒": "長", "⻕": "阜", "⻖": "阜", "⻗": "雨", "⻙": "韋", "⻞": "食", "⻟": "食", "⻠": "食", "⻣": "骨", "⻤": "鬼",
    "⻥": "魚", "⻦": "鳥", "⻧": "鹵", "⻨": "麥", "⻪": "黽", "⻫": "齊", "⻬": "齊", "⻭": "齒", "⻮": "齒", "⻯": "龍", "⻱": "龜", "⻲": "龜",
}
#: Marks of clauses and chapters, and the end of a sentence.
ARTICLE = r"第[一二三四五六七八九十百零\d]+条"
CLAUSE_MARK = r"^([一二三四五六七八九十百]+、|\d+[．.]|[（(][一二三四五六七八九十]+[)）]|第[一二三四五六七八九十百零\d]+条)"
SENTENCE_END = r"[。；：！？:；]$"
CHAPTER_LINE = r"(?m)^\s*第[一二三四五六七八九十]+章\s*[^\n]{0,20}$"
CHAPTER_TAIL = r"第[一二三四五六七八九十]+章[\s　]*[^\n。；：]{0,20}$"
#: Beginnings of lines that belong to no text.
JUNK = [
    "Tax Law", "TaxLaw", "Information in this database", "Due to time constraint", "Part A", "Part B", "Part C",
    "Proprietary and confidential", "Attachment", "Attachment List",
]
#: Site templates. Where a footer begins; lines that only a template has; words of a navigation line.
FOOTER = r"[^\S\n]*(?:纠错或建议|热门关键词|本站热词|网站标识码|当前位置\s*[:：]|京ICP备)"
SITE_LINE = (
    "^(搜索|高级搜索|成文日期|字体|分享到|【?打印】?$|【?下载】?$|发布日期|发布时间|索引号|来源|字号|正文下载|相关文章|扫一扫|"
    r"page\s*\d+\s*of\s*\d+|第\s*\d+\s*页\s*共\s*\d+\s*页)"
)
SITE_WORDS = (
    "ICP备|网站标识码|公网安备|网站地图|网站管理|访问统计|隐私声明|友情链接|无障碍浏览|版权所有|纠错或建议|热门关键词|本站热词|请输入关键词|请输入关键字|请输入您要搜索|"
    "请输入您要查询|智能问答|关怀版|热门搜索|Guangdong-Macao|合作区概览|横琴新视界|澳门办事处网站|一图读懂|答记者问|全部文件解读|搜一搜|收藏订阅|中国政府网|语言切换|"
    "无障碍模式|网站支持IPV6|微信扫一扫|当前位置|羊坊店西路|DEPARTMENTOF|移动门户|您所在的位置|Q搜索|"
    r"^\s*(?:联系我们|主办单位|主办\s*[:：]|承办单位|承办\s*[:：]|技术支持\s*[:：]|办公地址|邮政编码|相关附件\s*[:：]|首页\s*[>＞])"
)
NAVIGATION = (
    "首页|政务公开|政务服务|互动交流|信息公开|政府信息公开|新闻发布|纳税服务|总局概况|政策法规|政策解读|专题专栏|专题聚焦|动态新闻|通知公告|在线办事|常见问题|征集调查|"
    "咨询诉求|留言选登|采购招标|民生事务|统计数据|规划建设|法律服务|法律事务|金融服务|招商指引|信息公开指南|信息公开制度文件|信息公开目录|信息公开年度报告|信息依申请公开|"
    "广东政务服务网|全省政务服务一网通办|了解前海|投资前海|魅力横琴|合作区概览|合作区简介|机构领导|组织架构|横琴新视界|社交媒体目录|横琴总体方案全文|澳门办事处网站|"
    "一键Link|无障碍模式|无障碍浏览|语言切换|网站支持IPV6|微信扫一扫|i深圳|粤省事|粤商通|深i企|前海清风|搜索|高级搜索|关怀版|数据开放|智能问答|简体|繁体|En"
)
WEB_PREFIX = r"(?s)\A.*?(?=(?:财政部|国家税务总局|国务院|海关总署)[^\n]{0,20}(?:关于|公告|通知|令))"
#: What begins an annex, what only forms have, and how an annex opens within a text.
ANNEX_LINE = (
    r"[^\S\n]*(?:附件[^\S\n]*\d|附[^\S\n]*件[^\S\n]*$|附表|免税目录|进口目录|[^\n]{4,30}(?:清单|目录|一览表|汇总表|名单)[^\S\n]*$"
    r"|[一二三四五六七八九十百]+、[^\S\n]*[^\n]{2,60}(?:清单|目录|一览表|汇总表|名单)[^\S\n]*$)"
)
FORM = "填写说明|填报说明|申报表|申报附列资料|附列资料|税源明细表|金额单位|纳税人识别号"
LIST_TITLE = r"(?m)^[^\S\n]*[^\n]{4,30}(?:目录|清单|一览表|汇总表|名单)[^\S\n]*$"
ANNEX_OPENING = r"现将[^\n]{0,25}(?:公告|通知|公布)如下"
NOTE = r"(?s)[（(]\s*注\s*[:：][^）)]{0,600}[）)]?"
#: Labels of the block before an exported regulation.
META_LABELS = ["发文机关", "发布日期", "生效日期", "失效日期", "时效性", "文号", "相关法规", "法规文号", "效力状态"]

_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines_of(text: Column | str) -> Column:
    return F.split(text, _BREAK)


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility characters in their normal form; the JVM has no expression for it."""
    return texts.str.normalize("NFKC")


def normal(text: Column | str) -> Column:
    """NFKC, then radicals as the characters that they stand for."""
    return F.translate(nfkc(text), "".join(RADICALS), "".join(RADICALS.values()))


def strip_page_numbers(text: Column | str) -> Column:
    """Page numbers between dashes, also where a scan has run them into a sentence."""
    out = F.regexp_replace(text, r"(?U)[—–－]\s*\d{1,4}\s*[—–－]", "")
    return F.regexp_replace(out, r"(?U)(?<=[一-鿿])\s*[-–－]\s*\d{1,3}\s*[-–－]\s*(?=[一-鿿])", "")


def cut_footer(text: Column | str, share: float = 0.05) -> Column:
    """The text up to a site footer that begins behind its first twentieth and has no article below it.

    Only the first footer behind that point counts.
    """
    text = _col(text)
    head = F.floor(F.length(text) * share).cast("int")
    rest = F.substring(text, head + 1, F.length(text))
    at = F.regexp_instr(rest, F.lit(rf"(?U)(?<=\n)\s*{FOOTER}"))
    kept = F.substring(text, F.lit(1), head + at - 1)
    below = F.substring(text, head + at, F.length(text))
    return F.when((at > 0) & ~F.rlike(below, F.lit(rf"(?m)^\s*{ARTICLE}")), kept).otherwise(text)


def drop_site_lines(text: Column | str) -> Column:
    """Lines of a site's template; labels, which end in a colon, stay."""
    navigation = rf"(?U)^[\s|/\-—·>＞<>]*(?:(?:{NAVIGATION})[\s|/\-—·>＞<>]*)+$"

    def stays(line: Column) -> Column:
        s = trimmed(line)
        site = F.rlike(s, F.lit("(?U)" + SITE_WORDS)) | F.rlike(s, F.lit(navigation)) | F.rlike(s, F.lit("(?U)" + SITE_LINE))
        return F.rlike(s, F.lit("[:：]$")) | ~site

    return F.array_join(F.filter(lines_of(text), stays), "\n")


def canonic(text: Column | str) -> Column:
    """Normal characters, no page numbers, no site footer and no site lines, in this order."""
    return drop_site_lines(cut_footer(strip_page_numbers(normal(text))))


def strip_web_prefix(text: Column | str) -> Column:
    """What a site puts before the heading, unless an article is in it."""
    text = _col(text)
    prefix = F.regexp_extract(text, WEB_PREFIX, 0)
    return F.when(F.rlike(prefix, F.lit(rf"(?m)^\s*{ARTICLE}")), text).otherwise(F.substring(text, F.length(prefix) + 1, F.length(text)))


def bare(text: Column | str) -> Column:
    """A text without punctuation and white space, for comparison."""
    return F.regexp_replace(text, r"(?U)[\s．.、，,。；;：:（）()【】\[\]《》]", "")


def meta_head(text: Column | str) -> Column:
    """struct(meta, body): the labels with their values at the head of an export, and what follows them.

    A block begins within the first twelve lines and goes on as long as labels and values take turns.
    """
    text = _col(text)
    rows = F.filter(F.transform(lines_of(text), trimmed), lambda x: x != "")
    is_label = lambda x: F.regexp_replace(x, r"(?U)[：:]+$|\s+$", "").isin(META_LABELS)
    start = F.array_min(F.filter(F.transform(F.slice(rows, 1, 12), lambda x, i: F.when(is_label(x), i)), lambda i: i.isNotNull()))
    tail = F.slice(rows, start + 1, F.size(rows))
    # Labels stand at even places; the block ends at the first even place without one.
    ends = F.filter(F.transform(tail, lambda x, i: F.when((i % 2 == 0) & ~(is_label(x) & (i + 1 < F.size(tail))), i)), lambda i: i.isNotNull())
    n = F.coalesce(F.array_min(ends), F.size(tail) - F.size(tail) % 2)
    pairs = F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda k: F.struct(F.regexp_replace(F.get(tail, 2 * k), "[：:]+$", "").alias("k"), F.get(tail, 2 * k + 1).alias("v")))
    # A label that comes again overwrites the earlier value.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.k == p.k))
    empty = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    none = F.struct(empty.alias("meta"), text.alias("body"))
    found = F.struct(F.when(n > 0, F.map_from_entries(last)).otherwise(empty).alias("meta"), F.array_join(F.slice(tail, n + 1, F.size(tail)), "\n").alias("body"))
    return F.when(start.isNull(), none).otherwise(found)


_MARK, _END, _TAIL = re.compile(CLAUSE_MARK), re.compile(SENTENCE_END), re.compile(CHAPTER_TAIL)
_PAGE = re.compile(r"^\d+$")


def _unwrapped(text: str | None) -> list[str] | None:
    if text is None:
        return None
    done: list[str] = []
    for line in map(str.strip, text.splitlines()):
        if not line or _PAGE.match(line) or line.startswith(tuple(JUNK)):
            continue
        mark = _MARK.match(line)
        closed = bool(done) and bool(_END.search(done[-1]))
        # An article's number after an open sentence is a reference that the page has broken.
        reference = mark and mark[1][0] == "第" and done and not closed and not _TAIL.search(done[-1][-60:])
        if done and not closed and (not mark or reference):
            done[-1] += line
        else:
            done.append(line)
    return done


@F.pandas_udf(T.ArrayType(T.StringType()))
def unwrapped(texts: pd.Series) -> pd.Series:
    """Lines joined that the page has wrapped: a new one begins at a mark or after a sentence."""
    return texts.map(_unwrapped)


def strip_heading(text: Column | str, title: Column | str, number: Column | str, within: int = 12) -> Column:
    """A text without its title and its number among the first lines; both are known from elsewhere.

    Of the first line that has the title everything up to its end goes. The number is told by its
    year and count, since names of offices vary: its own line goes, or its part of a line.
    """
    title, number = _col(title), _col(number)
    year = F.regexp_extract(number, r"(\d{4})[^\d]{0,4}(\d+)\s*号", 1)
    count = F.regexp_extract(number, r"(\d{4})[^\d]{0,4}(\d+)\s*号", 2)
    cited = F.concat(year, F.lit(r"[^\d]{0,4}"), count, F.lit("号"))
    rows = F.transform(lines_of(text), trimmed)
    # The title and the number are looked for in the first lines only; the rest is kept as it is.
    head, rest = F.slice(rows, 1, within), F.slice(rows, within + 1, F.size(rows))
    has_title = lambda x: (title != "") & F.contains(x, title)
    first_title = F.array_min(F.filter(F.transform(head, lambda x, i: F.when(has_title(x), i)), lambda i: i.isNotNull()))
    behind = lambda x: F.substring(x, F.position(title, x) + F.length(title), F.length(x))
    no_title = F.transform(head, lambda x, i: F.when(i == first_title, behind(x)).otherwise(x))
    gone = F.transform(head, lambda x, i: F.coalesce((i == first_title) & (trimmed(behind(x)) == ""), F.lit(False)))
    has_number = lambda x: (year != "") & F.rlike(x, cited)
    first_number = F.array_min(F.filter(F.transform(no_title, lambda x, i: F.when(has_number(x), i)), lambda i: i.isNotNull()))
    own_line = lambda x: F.rlike(trimmed(x), F.lit("^[^\\n]{0,30}号$")) & has_number(x)
    after = lambda x: F.regexp_replace(x, F.concat(F.lit("^.*?"), cited), F.lit(""))
    no_number = F.transform(no_title, lambda x, i: F.when((i == first_number) & ~own_line(x), after(x)).when(i == first_number, "").otherwise(x))
    drop = F.transform(no_title, lambda x, i: F.coalesce((i == first_number) & (own_line(x) | (trimmed(after(x)) == "")), F.lit(False)))
    flags = F.zip_with(gone, drop, lambda a, b: a | b)
    kept = F.filter(F.zip_with(no_number, flags, lambda x, f: F.struct(x.alias("x"), f.alias("f"))), lambda r: ~r.f)
    return F.array_join(F.concat(F.transform(kept, lambda r: r.x), rest), "\n")


def split_at_opening(text: Column | str) -> Column:
    """struct(body, annex): another document that begins behind the first third, from its line on."""
    text = _col(text)
    least = F.greatest(F.lit(300), F.floor(F.length(text) * 0.3).cast("int"))
    at = F.regexp_instr(F.substring(text, least + 2, F.length(text)), F.lit(ANNEX_OPENING))
    before = F.substring(text, F.lit(1), least + at)  # all up to the opening
    line = F.length(before) - F.length(F.substring_index(before, "\n", -1))
    cut = F.struct(F.substring(text, F.lit(1), line).alias("body"), F.substring(text, line + 1, F.length(text)).alias("annex"))
    return F.when(at > 0, cut).otherwise(F.struct(text.alias("body"), F.lit("").alias("annex")))


def annex_segments(annex: Column | str) -> Column:
    """Pieces of an annex at its marks."""
    return F.filter(F.split(annex, rf"(?={ARTICLE}|[一二三四五六七八九十百]+、)"), lambda x: trimmed(x) != "")


def average_length(pieces: Column) -> Column:
    """Of an array of texts; 0 without any."""
    total = F.aggregate(pieces, F.lit(0), lambda a, x: a + F.length(x))
    return F.when(F.size(pieces) > 0, total / F.size(pieces)).otherwise(0.0)


def annex_kind(annex: Column | str) -> Column:
    """doc or table: chapters make a document; forms and titles of lists a table; else long pieces a document."""
    annex = _col(annex)
    head = F.array_join(F.slice(lines_of(annex), 1, 4), "\n")
    pieces = annex_segments(annex)
    return (
        F.when(F.rlike(annex, F.lit(CHAPTER_LINE)), "doc")
        .when(F.rlike(annex, F.lit(FORM)) | F.rlike(head, F.lit(LIST_TITLE)), "table")
        .when((F.size(pieces) >= 3) & (average_length(pieces) >= 60), "doc")
        .otherwise("table")
    )


def split_annex(text: Column | str) -> Column:
    """struct(body, annex, kind): the annex begins at the first line that says so outside of notes."""
    text = _col(text)
    # Lines within notes are hidden, length for length, so that places stay.
    notes = F.transform(F.regexp_extract_all(text, F.lit(f"({NOTE})"), F.lit(1)), lambda n: F.translate(n, "\n", "\u0002"))
    parts = F.zip_with(F.split(text, NOTE), notes, lambda g, n: F.concat(F.coalesce(g, F.lit("")), F.coalesce(n, F.lit(""))))
    at = F.regexp_instr(F.array_join(parts, ""), F.lit("(?m)^" + ANNEX_LINE))
    annex = F.substring(text, at, F.length(text))
    found = F.struct(F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"\n\z", "").alias("body"), annex.alias("annex"), annex_kind(annex).alias("kind"))
    return F.when(at > 0, found).otherwise(F.struct(text.alias("body"), F.lit("").alias("annex"), F.lit("").alias("kind")))
