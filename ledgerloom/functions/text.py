"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Search terms, and words that are none.
TERM = "[一-龥]{2,}|[A-Za-z0-9]{2,}"
STOP = ["我们", "可以", "进行", "以及", "通过", "相关", "情况", "问题", "需要", "是否", "如何"]

#: The redactions, in order. Java's \\b and \\d are ASCII, so word borders beside
#: Chinese characters are spelled out.
_B, _E = r"(?<![0-9A-Za-z_一-龥])", r"(?![0-9A-Za-z_一-龥])"
REDACTIONS = [
    (r"[A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9-]{2,}(?:\s*\.\s*[A-Za-z0-9-]+)*", "[邮箱]"),
    (_B + r"1[3-9][0-9]{9}" + _E, "[手机号]"),
    (_B + r"1[3-9][0-9][\s-]?[0-9]{4}[\s-]?[0-9]{4}" + _E, "[手机号]"),
    (_B + r"0[0-9]{2,3}[\s-]?[0-9]{3,4}[\s-]?[0-9]{4}" + _E, "[电话]"),
    (r"\+86[\s-]?[0-9]{2,3}[\s-]?[0-9]{3,4}[\s-]?[0-9]{4}", "[电话]"),
    (_B + r"[0-9]{15,18}[0-9Xx]?" + _E, "[证件号]"),
    (_B + r"(?:[0-9][ -]?){15,19}(?<=[0-9])" + _E, "[账号]"),
    (r"(地址|住所)[：:]\s*\S+", "$1：[地址]"),
    (r"[一-龥]{2,12}(?:路|大道|街|巷|弄)[一-龥]{0,6}?\s*[0-9]{1,5}\s*号[一-龥0-9]{0,20}", "[地址]"),
    (r"[一-龥]{2,12}(?:大厦|广场|大楼)\s*[0-9]*\s*(?:[A-Z座栋]|[一二三四五六七八九十]+栋)?\s*[0-9]*\s*[楼层室]?[^\s，。；、）)]{0,12}", "[地址]"),
    ("安永华明会计师事务所（特殊普通合伙）|安永华明会计师事务所|安永华明|安永（中国）企业咨询有限公司|安永（中国）|安永", "[事务所]"),
    ("普华永道|PwC|PricewaterhouseCoopers", "[事务所]"),
    ("德勤华永|德勤|Deloitte", "[事务所]"),
    ("毕马威|KPMG", "[事务所]"),
    (r"(?i)Ernst\s*&\s*Young", "[事务所]"),
    (r"Wolters\s*Kluwer|威科先行", "[数据库]"),
    (r"(?:\[事务所\]\s*)?企业咨询\s*[（(]\s*中国\s*[)）]\s*有限(?:责任)?公司", "[事务所]"),
]

#: Lines that are only noise.
NOISE_LINE = r"(?m)^[ \t]*(?:[0-9]{1,3}|初稿|终稿|讨论稿|定稿|草稿|DRAFT|Draft|FINAL|Final|目录|引言|序号|附注|注释|谢谢|感谢聆听)[ \t]*$"
#: Scripts that only a broken font brings (Hebrew to Thaana, the Indic scripts to Ethiopic,
#: Khmer, Coptic, Georgian, Bopomofo, Hangul), and characters that are ordinary.
FOREIGN = "[\u0590-\u07bf\u0900-\u137f\u1780-\u17ff\u2c80-\u2cff\u2d00-\u2d2f\u3100-\u318f\uac00-\ud7af]"
ORDINARY = "[一-鿿＀-￯0-9A-Za-z \n\t.,;:()\\[\\]{}%*\\-/+=&'\"、。，；：（）《》〈〉「」“”‘’！？…—·【】％]"
#: A share.
SHARE = r"([0-9]{1,3}(?:\.[0-9]+)?)\s*%"
#: Sizes of amounts and their units.
AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(亿元|百万元|万元|千元|元)"
UNITS = {"元": 1.0, "千元": 1e3, "万元": 1e4, "百万元": 1e6, "亿元": 1e8}
MAGNITUDES = [(1e8, "亿级"), (1e7, "千万级"), (1e6, "百万级"), (1e5, "十万级"), (1e4, "万级")]


def terms(query: str) -> list[str]:
    """The terms of one query, repeats kept."""
    import re

    return [t for t in re.findall(TERM, query or "") if t not in STOP]


def terms_col(text: Column | str) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(STOP))


def occurrences(text: Column | str, term: str) -> Column:
    """How often ``term`` is in the text, overlaps not counted."""
    text = F.col(text) if isinstance(text, str) else text
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")


def term_score(text: Column | str, words: list[str]) -> Column:
    """Occurrences of all words; a word named twice counts twice."""
    out = F.lit(0).cast("long")
    for w in words:
        out = out + occurrences(text, w)
    return out


def snippet(text: str, words: list[str], before: int = 200, after: int = 600) -> Column:
    """The surroundings of the first word found, white space collapsed."""
    places = [F.nullif(F.locate(w, F.col(text)), F.lit(0)) for w in words]
    at = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(0)) - 1
    start = F.greatest(at - before, F.lit(0))
    return F.trim(F.regexp_replace(F.substring(F.col(text), start + 1, at + after - start), r"\s+", " "))


#: Rules up to here look for a mail address and for digits; the others for Chinese or for one of these names.
_MAIL, _DIGITS = 1, 7
def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often and in whatever lambda ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


_NAMED = r"[一-龥]|PwC|Pricewaterhouse|Deloitte|KPMG|(?i:ernst)|Wolters"


def redact(text: Column | str) -> Column:
    """All redactions, in order; a text is held only against those that may find something in it.

    The part of a mail address before its sign is looked for only where such a run begins, as a long
    run of letters would be tried from each of its characters.
    """
    text = F.col(text) if isinstance(text, str) else text

    def applied(first: int, last: int) -> Column:
        out = text
        for k, (pattern, by) in list(enumerate(REDACTIONS))[first:last]:
            out = F.regexp_replace(out, pattern if k else r"(?:\G|(?<![A-Za-z0-9._%+-]))" + pattern.replace("+-]+", "+-]++", 1), by)
        return out

    mail, digits = F.contains(text, F.lit("@")), F.rlike(text, F.lit("[0-9]"))
    some = F.when(mail & digits, applied(0, _DIGITS)).when(mail, applied(0, _MAIL)).when(digits, applied(_MAIL, _DIGITS)).otherwise(text)
    return F.when(F.rlike(text, F.lit(_NAMED)), applied(0, len(REDACTIONS))).otherwise(some)


def mask_amounts(text: Column | str) -> Column:
    """Each amount becomes its order of magnitude.

    The text is cut at its amounts; the values of those between are folded back in one pass.
    """
    text = F.col(text) if isinstance(text, str) else text
    gaps = F.split(text, AMOUNT.replace("(亿", "(?:亿").replace("([0-9]", "(?:[0-9]"))
    part = lambda k: F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(k))
    found = F.zip_with(part(1), part(2), lambda n, u: F.struct(n.alias("n"), u.alias("u")))

    def size(x: Column) -> Column:
        unit = F.lit(1.0)
        for name, factor in UNITS.items():
            unit = F.when(x.u == name, factor).otherwise(unit)
        value = F.try_to_number(F.translate(x.n, ",", ""), F.lit("9999999999999999D999999")).cast("double") * unit
        out = F.lit("[金额]")
        for least, name in reversed(MAGNITUDES):
            out = F.when(value >= least, f"[金额≈{name}]").otherwise(out)
        return out

    masks = F.concat(F.transform(found, size), F.array(F.lit("")))
    both = F.zip_with(gaps, masks, lambda g, m: F.array(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit(""))))
    return F.array_join(F.flatten(both), "")


def collapse_doubled(text: Column | str) -> Column:
    """A word that is written twice without a gap."""
    return F.regexp_replace(text, r"([A-Za-z]{4,})\1", "$1")


def strip_noise(text: Column | str) -> Column:
    """Page numbers and status words on lines of their own go; blank lines and spaces are gathered."""
    out = F.regexp_replace(text, NOISE_LINE, "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"[ \t]{2,}", " ")


def slug(text: Column | str, cut: int = 60) -> Column:
    out = F.regexp_replace(text, "[^0-9A-Za-z_一-龥]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(out, "^-+|-+$", ""), 1, cut), F.lit("")), F.lit("entry"))


def squeeze(text: Column | str) -> Column:
    return F.regexp_replace(text, r"[\s　]+", "")


def fingerprint(text: Column | str, chars: int = 4000, digits: int = 12) -> Column:
    """The first digits of the hash of a text without its white space."""
    return F.substring(F.sha2(F.substring(squeeze(text), 1, chars), 256), 1, digits)


def is_english(text: Column | str) -> Column:
    """Under 2 % of the letters are Chinese."""
    cjk, latin = F.regexp_count(text, F.lit("[一-鿿]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return (latin > 0) & (cjk < 0.02 * (cjk + latin))


def garbled(text: Column | str, least: float = 0.6) -> Column:
    """Characters of a script that no such text has, or too few that are ordinary; white space at the ends is set aside."""
    inner = F.regexp_replace(text, r"^\s+|\s+$", "")
    few = F.regexp_count(inner, F.lit(ORDINARY)) < least * F.length(inner)
    return (F.length(inner) > 0) & (F.rlike(inner, F.lit(FOREIGN)) | few)


def generalize(text: Column | str) -> Column:
    """Exact shares become tiers of control, by their value; dates keep their year."""
    text = F.col(text) if isinstance(text, str) else text
    gaps = F.split(text, SHARE.replace("(", "(?:", 1).replace("(?:?:", "(?:"))
    shares = F.regexp_extract_all(text, F.lit(SHARE), F.lit(1))
    tier = lambda v: F.when(v >= 99.5, "[全资]").when(v >= 50, "[控股]").otherwise("[参股]")
    tiers = F.transform(shares, lambda x: tier(x.cast("double")))
    out = F.array_join(F.zip_with(gaps, tiers, lambda g, t: F.concat(F.coalesce(g, F.lit("")), F.coalesce(t, F.lit("")))), "")
    return F.regexp_replace(out, r"(20[0-9]{2})\s*年\s*[0-9]{1,2}\s*月(?:\s*[0-9]{1,2}\s*日)?", "$1年")


def base26(n: Column) -> Column:
    """A, B ... Z, AA, AB ... ZZ from 0."""
    letter = lambda x: F.char(F.lit(65) + x)
    return F.when(n < 26, letter(n % 26)).otherwise(F.concat(letter(F.floor(n / 26).cast("int") - 1), letter(n % 26)))


def version_array(version: Column | str) -> Column:
    """Numbers of a dotted version, a suffix after a hyphen ignored, for comparison."""
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(version, "^[vV]", ""), "-.*$", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def front_matter(text: Column | str, key: str) -> Column:
    """The value of ``key:`` in the first 12 lines, empty if it is missing."""
    head = F.slice(F.split(text, "\n"), 1, 12)
    own = F.filter(head, lambda x: F.startswith(F.trim(x), F.lit(f"{key}:")))
    return F.coalesce(F.trim(F.regexp_replace(F.get(own, F.lit(0)), "^[^:]*:", "")), F.lit(""))


def front_fields(text: Column | str) -> Column:
    """All ``key: value`` lines of the head between the first two rules, as a map; of equal keys the first counts."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    rows = F.filter(F.split(head, "\n"), lambda x: F.rlike(x, F.lit(r"^\s*[^:\s][^:]*:")))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q.k == p.k))
    return F.map_from_entries(first)


def body(text: Column | str) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n+", "")


def json_or_raw(text: Column | str, schema: str) -> Column:
    """struct(value, raw): the parsed text, or the text itself where it is no such JSON."""
    value = F.from_json(text, schema)
    whole = F.rlike(text, F.lit(r"(?s)^\s*[\[{].*[\]}]\s*$"))
    kept = F.when(whole, value)
    return F.struct(kept.alias("value"), F.when(kept.isNull(), text if isinstance(text, Column) else F.col(text)).alias("raw"))


def json_object(text: Column | str) -> Column:
    """The outermost braces of a model's answer."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
