"""Cleaning documents: repeated lines, copies, leaks, site frames, runs of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import masks
from ..functions import text as tx
from . import matching
from .running import with_earlier_blocks

#: What may still leak from a cleaned document, by kind.
LEAKS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+",
    "phone": r"[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}",
    "long_number": r"[0-9]{15,19}",
    "address": r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
}


def lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line_no, line) of every line."""
    return docs.select(id_col, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def drop_repeated_lines(text: Column | str, times: int = 5, longest: int = 80) -> Column:
    """Running headers: short lines that come often within one document become blank.

    Sorted once, equal lines lie together, so one look at the neighbours ``times`` places away
    tells which come often enough.
    """
    text = text if isinstance(text, Column) else F.col(text)
    often = lambda few: F.array_distinct(F.filter(few, lambda x, i: F.get(few, i + (times - 1)) == x))
    short = lambda parts: F.array_sort(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= longest)))

    def blanked(text: Column, often: Column) -> Column:
        kept = F.transform(F.split(text, "\n"), lambda x: F.when(F.array_contains(often, F.trim(x)), "").otherwise(x))
        return F.when(F.size(often) > 0, F.array_join(kept, "\n")).otherwise(text)

    # The lines are bound before a lambda names them, or it would cut and sort the text again for each line.
    return tx.once(text, lambda t: tx.once(tx.once(short(F.split(t, "\n")), often), lambda o: blanked(t, o)))


def repeated_lines(docs: DataFrame, times: int = 5, longest: int = 80) -> DataFrame:
    """(doc_id, line, n) of the lines that ``drop_repeated_lines`` blanks."""
    each = lines(docs).select("doc_id", F.trim("line").alias("line")).where((F.col("line") != "") & (F.length("line") <= longest))
    return each.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def clean(text: Column | str) -> Column:
    """Doubled words, personal data, noise lines and running headers, in this order."""
    return drop_repeated_lines(tx.strip_noise(tx.once(tx.collapse_doubled(text), tx.redact)))


def desensitized(text: Column | str, watched: list[str] | None = None) -> Column:
    """The whole chain for a text that leaves the house.

    Doubled words, personal data, lists of clients, notices and noise, running headers, watched names,
    names behind labels, and placeholders side by side, in this order.
    """
    out = masks.strip_boilerplate(masks.hide_rosters(tx.once(tx.collapse_doubled(text), tx.redact)))
    out = drop_repeated_lines(tx.strip_noise(out))
    out = masks.mask_people(masks.mask_watched(masks.merge_branches(out), watched or []))
    return masks.merge_marks(out)


def fingerprint_dedupe(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """Of documents with equal fingerprints the longest stays, of equally long ones that with the greatest name."""
    rows = docs.select(name, F.length("text").alias("n"), tx.fingerprint("text").alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.max_by(name, F.struct("n", name)).alias("kept"), F.count("*").alias("copies"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, whole. Combined before the shuffle, so crowded keys cost no more."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(least).select(*keys, "r.*").select(df.columns)


def leaks(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, n, examples): distinct findings of each kind."""
    found = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.array_distinct(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))).alias("v")) for kind, p in LEAKS.items()]
    )
    rows = docs.select("doc_id", F.explode(found).alias("f")).where(F.size("f.v") > 0)
    return rows.select("doc_id", "f.kind", F.size("f.v").alias("n"), F.array_join("f.v", "|").alias("examples"))


#: Findings of an audit, by kind; a title before a name, and beginnings that are no company.
AUDIT = {
    "精确金额": r"(\d[\d,]*(?:\.\d+)?\s*(?:亿元|万元|千元))",
    "地址": r"([一-龥]{2,12}(?:路|大道|街|巷|弄)[一-龥]{0,6}?\s*\d{1,5}\s*号)",
    "邮箱": r"([A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9-]{2,}(?:\s*\.\s*[A-Za-z0-9-]+)*)",
    "电话": r"((?:\+86[\s-]?)?1[3-9]\d[\s-]?\d{4}[\s-]?\d{4}|\b0\d{2,3}[\s-]?\d{3,4}[\s-]?\d{4}\b)",
}
CHINESE_COMPANY = "[一-龥（）()]{2,22}(?:有限公司|股份有限公司|有限责任公司|集团有限公司|合伙企业（有限合伙）|合伙企业)"
FOREIGN_COMPANY = (
    r"\b([A-Z][A-Za-z&.'\-]+(?:\s+[A-Z][A-Za-z&.'\-]+){0,4}\s+"
    r"(?:Ltd\.?|Limited|Inc\.?|Corp\.?|Corporation|Company|Holdings?|Group|Capital|Partners?|LLC|PLC|GmbH|B\.?V\.?|N\.?V\.?))\b"
)
CODED_BEFORE = r"(?:(?:公司|个人)[A-Z]{1,2}|\[事务所\]|\[数据库\]|\[实体\])"
NO_COMPANY = r"^(The|This|Our|A|An|Retail|Company|Global)\b"
NAME_TITLES = "(?:合伙人|总经理|总监|董事|经理|先生|女士|老师|博士|顾问)"


def audit(docs: DataFrame, watched: list[str] | None = None, masked: list[str] | None = None) -> DataFrame:
    """(doc_id, is_client, kind, value, place): what a cleaned document still gives away, each finding once.

    Companies, exact amounts, addresses, mail and phones, names on a list, and what may be a name
    behind a title. ``masked`` names may stand; the end of a company's name behind its code does too.
    A document is a client's if its head says so. ``place`` keeps the order in which they were found.
    """
    text = F.col("text")
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    known = F.array(*[F.lit(x) for x in masked]) if masked else F.array().cast("array<string>")
    plain = F.regexp_replace(text, f"({CODED_BEFORE})({CHINESE_COMPANY})", "$1")
    chinese = F.filter(F.regexp_extract_all(plain, F.lit(f"({CHINESE_COMPANY})"), F.lit(1)), lambda n: ~F.array_contains(known, n))
    foreign = F.filter(found(FOREIGN_COMPANY), lambda n: ~F.exists(known, lambda k: F.lower(k) == F.lower(n)) & ~F.rlike(n, F.lit(NO_COMPANY)))
    listed = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in watched])) if watched else F.array().cast("array<string>")
    given = found(rf"{NAME_TITLES}\s*[:：]?\s*([一-龥]{{2,4}})")
    likely = F.filter(given, lambda n: F.rlike(n, F.lit(f"^[{masks.SURNAMES}]")) & ((F.length(n) > 2) | F.rlike(n, F.lit("^.[先生女士总]"))) & ~F.array_contains(listed, n))
    kinds = {"中文公司名": chinese, "英文公司名": foreign} | {k: found(p) for k, p in AUDIT.items()} | {"人名": listed, "可能人名": likely}
    rows = F.flatten(F.array(*[_named(kind, v) for kind, v in kinds.items()]))
    client = F.contains(F.substring("text", 1, 300), F.lit("type: 筹划案"))
    return docs.select("doc_id", client.alias("is_client"), F.posexplode(F.array_distinct(rows)).alias("place", "r")).select("doc_id", "is_client", "r.kind", "r.value", "place")


def _named(kind: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))


def strip_frames(pages: DataFrame, share: float = 0.02, least: int = 3) -> DataFrame:
    """Page texts without the lines that many pages have: navigation, headers and footers.

    Tags and scripts go first. A line is frame if it is on at least ``least`` pages and on that
    share of all. A page of which nothing is left has an empty text.
    """
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n"), r"<[^>]*>", "\n")
    rows = pages.select("page_id", F.posexplode(F.split(plain, "\n")).alias("line_no", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).where("line <> ''")
    total = pages.agg(F.count("*").alias("total"))
    on = rows.groupBy("line", "page_id").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    frame = on.crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select("line")  # one row
    kept = rows.join(frame, "line", "left_anti")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line)
    texts = kept.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.array_join(ordered, "\n").alias("text"))
    whole = pages.select("page_id").join(texts, "page_id", "left")
    return whole.select("page_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("text", F.lit("")).alias("text"))


def line_runs(docs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, start, n, line): equal lines that follow each other at least so often."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    new = F.when(F.lag("line").over(order).eqNullSafe(F.col("line")), 0).otherwise(1)
    runs = lines(docs).withColumn("new", new).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy("doc_id", "run").agg(F.min("line_no").alias("start"), F.count("*").alias("n"), F.first("line").alias("line"))
    return runs.where(F.col("n") >= least).drop("run")


def unique_names(docs: DataFrame, base: Column, order: str = "doc_id") -> DataFrame:
    """``name``: the base for the first of its kind, base-2, base-3 ... for the next. ``order`` is a whole number."""
    rows = with_earlier_blocks(docs.select(order, base.alias("base")), "base", order, F.lit(1))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("base", "block").orderBy(order)) + F.col("before"))
    return rows.select(order, F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n")).alias("name"))


#: Passages that are broadcast by their hashes, at most; more of them are met by a shuffle.
PASSAGES = 100_000


def contained(docs: DataFrame, passages: DataFrame, most: int = PASSAGES) -> DataFrame:
    """(doc_id, item_id), once each: the whole passage, its case and spacing set aside, is in the document as whole words (``matching.contained``)."""
    return matching.contained(docs, passages, most)
