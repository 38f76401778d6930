"""Catalogues, guides and groups: context carried along rows, headings, counters, batches and stamps."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import settled
from .running import with_earlier_blocks, with_place

#: Lines of a catalogue by what they begin.
PART = "^(?:.*?)(全国鼓励外商投资产业目录|中西部等地区外商投资优势产业目录|中西部地区外商投资优势产业目录)$"
PROVINCE = "^[一-鿿]{2,8}(?:省|自治区|市)(?:（[^）]{0,20}）)?$"
SECTION = r"^([一二三四五六七八九十]+)、([^\d。；]{2,30})$"
SUBSECTION = r"^（([一二三四五六七八九十]+)）([^\d。；]{2,30})$"
ENTRY = r"(?s)^(\d+)[.．](.*)$"
#: Entries may skip so many numbers; a larger step is a number within a text.
STEP = 5
#: What is no heading or text on a page.
PAGE_NUMBER = r"^[\divxlIVXLCDM]{1,6}$"
CONTACT = r"@|\+\d|\bTel\b|\bPhone\b|\bMobile\b|\bFax\b"
OTHER = "其他"


def _carried(value: Column, resets: Column, doc: str, order: str) -> Column:
    """The last value up to a row, unless something has reset it since."""
    w = W.partitionBy(doc).orderBy(order)
    return F.last(F.when(value.isNotNull(), value).when(resets, F.lit("")), True).over(w)


def catalogue_rows(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, num, text, part, province, section, subsection) of the entries of a catalogue's ``lines(doc, line_no, line)``.

    A part clears what is below it, a province the sections, a section its subsections. Entries
    count up within a part or province; a number that does not go on from the last one, and every
    other line but notes, belongs to the entry above it.
    """
    s = F.trim("line")
    kind = (
        F.when(F.rlike(s, F.lit(PART)) & (F.length(s) <= 30), "part").when(F.rlike(s, F.lit(PROVINCE)), "province").when(F.rlike(s, F.lit(SECTION)), "section")
        .when(F.rlike(s, F.lit(SUBSECTION)), "subsection").when(F.rlike(s, F.lit(ENTRY)), "entry").otherwise("more")
    )
    rows = lines.where(s != "").select(doc, "line_no", s.alias("s"), kind.alias("kind"))
    of = lambda *kinds: F.col("kind").isin(*kinds)
    part = F.when(of("part"), F.regexp_extract("s", PART, 1))
    w = W.partitionBy(doc).orderBy("line_no")
    rows = rows.withColumn("block", F.count_if(of("part", "province")).over(w))  # entries count up within a block
    rows = (
        rows.withColumn("part", F.last(part, True).over(w))
        .withColumn("province", _carried(F.when(of("province"), F.col("s")), of("part"), doc, "line_no"))
        .withColumn("section", _carried(F.when(of("section"), F.col("s")), of("part", "province"), doc, "line_no"))
        .withColumn("subsection", _carried(F.when(of("subsection"), F.col("s")), of("part", "province", "section"), doc, "line_no"))
    )
    # Which numbers go on from the last accepted one is a fold over a block's numbers.
    numbers = rows.where(of("entry")).select(doc, "block", "line_no", F.regexp_extract("s", ENTRY, 1).try_cast("bigint").alias("n"))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        ok = F.when(a.last.isNull(), x.n == 1).otherwise((x.n > a.last) & (x.n <= a.last + STEP))
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(x.n.alias("last"), F.concat(a.kept, F.array(x.line_no)).alias("kept"))).otherwise(a)

    ordered = F.array_sort(F.collect_list(F.struct(F.col("line_no").cast("int").alias("line_no"), "n")))
    good = numbers.groupBy(doc, "block").agg(F.aggregate(ordered, start, step, lambda a: a.kept).alias("kept"))
    good = good.select(doc, "block", F.explode("kept").alias("line_no")).withColumn("opens", F.lit(True)).drop("block")
    rows = rows.join(good, [doc, "line_no"], "left").withColumn("opens", F.coalesce("opens", F.lit(False)))
    # A heading closes the entry above it: lines below belong to no entry until the next opens.
    heading = of("part", "province", "section", "subsection")
    rows = rows.withColumn("e", F.count_if(F.col("opens") | heading).over(w)).where(~heading)
    more = ~F.col("opens") & (of("entry") | ~(F.startswith("s", F.lit("附件")) | F.startswith("s", F.lit("注："))))
    piece = F.when(F.col("opens"), F.regexp_extract("s", ENTRY, 2)).when(more, F.col("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("line_no", piece.alias("p"))))), lambda x: x.p), "")
    at = lambda c: F.min_by(c, F.when(F.col("opens"), F.col("line_no")))
    entries = rows.groupBy(doc, "e").agg(
        F.bool_or("opens").alias("opened"), at("line_no").alias("line_no"), at(F.regexp_extract("s", ENTRY, 1)).alias("num"), text.alias("text"),
        *[F.coalesce(at(c), F.lit("")).alias(c) for c in ("part", "province", "section", "subsection")],
    )
    return entries.where("opened").drop("e", "opened")


def catalogue_line() -> Column:
    """The line of an entry with all that it belongs to, as a search meets lines one by one."""
    home = F.when(F.col("province") != "", F.concat(F.regexp_replace("province", "（[^）]*）", ""), F.lit("鼓励外商投资优势产业"))).when(F.col("part") != "", F.col("part")).otherwise("目录")
    above = F.filter(F.array("section", "subsection"), lambda x: x != "")
    return F.concat(F.lit("- "), home, F.lit(" · "), F.array_join(F.concat(above, F.array(F.concat("num", F.lit("."), "text"))), "｜"))


def running_headers(page_lines: DataFrame, pages: int = 10, largest: float = 11.0) -> DataFrame:
    """(doc, text, n): small lines that come back on at least so many lines of a document's pages."""
    small = page_lines.where(F.col("size") <= largest)
    return small.groupBy("doc", "text").agg(F.count("*").alias("n")).where(F.col("n") >= pages)


def heading_size(page_lines: DataFrame, lexicon: DataFrame, least: float = 12.0, default: float = 13.0) -> DataFrame:
    """(doc, size): the size most headings of a document have; of equals the one that comes first.

    A page counts with its first line of at least ``least`` points that is no page number, if the
    lexicon has it.
    """
    big = page_lines.where((F.col("size") >= least) & ~F.rlike("text", F.lit(PAGE_NUMBER)))
    firsts = big.groupBy("doc", "page").agg(F.min_by(F.struct("size", "text"), "line_no").alias("f")).select("doc", "page", "f.*")
    known = firsts.join(lexicon.select("text").distinct(), "text", "left_semi")
    sizes = known.groupBy("doc", "size").agg(F.count("*").alias("n"), F.min("page").alias("at"))
    best = sizes.groupBy("doc").agg(F.max_by("size", F.struct("n", (-F.col("at")).alias("a"))).alias("size"))
    return page_lines.select("doc").distinct().join(best, "doc", "left").select("doc", F.coalesce("size", F.lit(default)).alias("size"))


def headings(page_lines: DataFrame, lexicon: DataFrame, sizes: DataFrame, pages: int = 10) -> DataFrame:
    """(doc, page, line_no, text): a page's heading is its first line that is no noise, if the lexicon has
    it and it has the document's heading size or is a title page's."""
    headers = running_headers(page_lines, pages).select("doc", "text", F.lit(True).alias("header"))
    listed = lexicon.select("text", F.lit(True).alias("known")).distinct()
    rows = page_lines.join(headers, ["doc", "text"], "left").join(listed, "text", "left")
    known = F.coalesce("known", F.lit(False))
    noise = (
        (F.col("size") < 8.3) | F.rlike("text", F.lit(PAGE_NUMBER)) | F.rlike("text", F.lit(CONTACT)) | (known & (F.col("size") < 11.5))
        | (F.coalesce("header", F.lit(False)) & (F.col("size") <= 11.0))
    )
    first = rows.where(~noise).groupBy("doc", "page").agg(F.min_by(F.struct("line_no", "text", "size", known.alias("known")), "line_no").alias("f")).select("doc", "page", "f.*")
    both = first.join(sizes.withColumnRenamed("size", "head"), "doc")
    fits = F.col("known") & (F.length("text") <= 60) & ((F.col("size") == F.col("head")) | (F.col("size") >= 30))
    return both.where(fits).select("doc", "page", "line_no", "text")


def merge_sections(sections: DataFrame, least: int = 400) -> DataFrame:
    """Neighbouring sections (doc, pos, name, paragraphs) of one name become one; short ones go."""
    order = W.partitionBy("doc").orderBy("pos")
    new = F.when(F.lag("name").over(order).eqNullSafe(F.col("name")), 0).otherwise(1)
    rows = sections.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paragraphs"))), lambda x: x.paragraphs))
    merged = rows.groupBy("doc", "island").agg(F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"), joined.alias("paragraphs"))
    length = F.aggregate("paragraphs", F.lit(0), lambda a, x: a + F.length(x))
    return merged.where(length >= least).drop("island")


def ambiguous_numbers(docs: DataFrame) -> DataFrame:
    """``docs(number, name ...)`` with ``ambiguous`` and ``display``: a number that several documents have gets their short title."""
    from ..functions.metadata import short_title

    several = docs.groupBy("number").agg(F.count("*").alias("n")).where("n > 1 AND number IS NOT NULL").select("number", F.lit(True).alias("ambiguous"))
    # Written first, so that Spark can split a number that very many documents have.
    rows = docs.where("number IS NOT NULL").join(settled(several), "number", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
    return rows.withColumn("display", F.when(F.col("ambiguous"), F.concat("number", F.lit("·"), short_title("name"))).otherwise(F.col("number")))


def index_totals(clauses: DataFrame) -> DataFrame:
    """One row: documents, clauses, void or partly void ones, subjects, documents with an annex, and tax and rule pairs.

    ``clauses`` has doc, status, subjects, has_annex, taxes and rules.
    """
    totals = clauses.agg(
        F.count_distinct("doc").alias("n_docs"),
        F.count("*").alias("n_clauses"),
        F.count_if(F.col("status").isin("已作废", "部分作废")).alias("n_void"),
        F.count_distinct(F.when(F.col("has_annex"), F.col("doc"))).alias("n_annexes"),
    )
    subjects = clauses.select(F.explode("subjects").alias("s")).agg(F.count_distinct("s").alias("n_subjects"))
    pairs = clauses.select(F.explode("taxes").alias("t"), "rules").select("t", F.explode("rules").alias("r")).agg(F.count_distinct("t", "r").alias("n_buckets"))
    return totals.crossJoin(F.broadcast(subjects)).crossJoin(F.broadcast(pairs))  # one row each


#: How many samples of a kind a report has, and how many characters of each.
SAMPLES = {"untaxed": (30, 100), "no_subject": (40, 100), "unclassified": (60, 90)}


def report_samples(rows: DataFrame, samples: dict[str, tuple[int, int]] = SAMPLES) -> DataFrame:
    """(kind, place, pos, text, total): the first of ``rows(kind, pos, text)`` of each kind, cut, with the number of all of them.

    Each task keeps its own first ones before anything is moved. Kinds without a limit are no samples and left out.
    """
    most = F.create_map(*[F.lit(x) for k, (n, _) in samples.items() for x in (k, n)])
    cut = F.create_map(*[F.lit(x) for k, (_, n) in samples.items() for x in (k, n)])
    known = rows.where(F.col("kind").isin(list(samples)))
    totals = known.groupBy("kind").agg(F.count("*").alias("total"))
    order = W.partitionBy("kind").orderBy(F.asc_nulls_last("pos"), "text")
    first = known.select("kind", "pos", "text", F.row_number().over(order).alias("place")).where(F.col("place") <= max(n for n, _ in samples.values()))
    first = first.where(F.col("place") <= F.element_at(most, F.col("kind")))
    text = F.substring(F.col("text"), F.lit(1), F.element_at(cut, F.col("kind")))
    return first.join(totals, "kind").select("kind", "place", "pos", text.alias("text"), "total")


def by_part(rows: DataFrame) -> DataFrame:
    """Entries of a catalogue by part."""
    return rows.groupBy("part").agg(F.count("*").alias("n"))


def collect_groups(lines: DataFrame) -> DataFrame:
    """(tax, rule, title, n, sample, lines) of the groups in files of ``lines(tax, rule, line_no, line)``.

    A line with ## opens a group, lines with a dash are its clauses; the sample is the beginning of
    the first. Lines before the first group, and groups without a clause, are left out.
    """
    order = W.partitionBy("tax", "rule").orderBy("line_no")
    rows = lines.withColumn("g", F.count_if(F.startswith("line", F.lit("## "))).over(order)).where("g > 0")
    clause = F.startswith("line", F.lit("- "))
    groups = rows.groupBy("tax", "rule", "g").agg(
        F.trim(F.substring(F.min_by("line", "line_no"), 4, 1 << 20)).alias("title"),
        F.count_if(clause).alias("n"),
        F.substring(F.min_by(F.substring("line", 3, 1 << 20), F.when(clause, F.col("line_no"))), 1, 80).alias("sample"),
        F.transform(F.array_sort(F.collect_list(F.when(clause, F.struct("line_no", "line")))), lambda x: x.line).alias("lines"),
    )
    return groups.where("n > 0").drop("g")


def group_id(tax: Column | str, rule: Column | str, title: Column | str) -> Column:
    """A group's lasting id: not its place, which new batches would move."""
    return F.concat_ws("|", tax, rule, title)


def with_topics(groups: DataFrame, mapping: DataFrame) -> DataFrame:
    """``groups`` with the topic of ``mapping(tax, rule, title, topic)``; groups that it leaves out are of no special one."""
    keys = ["tax", "rule", "title"]
    return groups.join(mapping.select(*keys, "topic"), keys, "left").withColumn("topic", F.coalesce("topic", F.lit(OTHER)))


def topics_by_size(groups: DataFrame) -> DataFrame:
    """(tax, topic, n) with the largest first."""
    return groups.groupBy("tax", "topic").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tax", "topic")


def prune_groups(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, line) without groups that have nothing but blank lines below their title.

    No clause can go with them; a group with any other text stays as it is.
    """
    order = W.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("g", F.count_if(F.startswith("line", F.lit("## "))).over(order))
    full = rows.where(F.col("g").eqNullSafe(F.lit(0)) | ((F.trim("line") != "") & ~F.startswith("line", F.lit("## ")))).select("file", "g").distinct()
    return rows.join(full, ["file", "g"], "left_semi").drop("g")


def untaxed(docs: DataFrame, taxed: DataFrame, delivered: DataFrame, name: str = "doc") -> DataFrame:
    """Documents with an event that no tax has and that have not been delivered."""
    return docs.join(taxed.select(name), name, "left_anti").join(delivered.select(name), name, "left_anti")


def label_maps(maps: DataFrame, key: str = "id", order: str = "batch") -> DataFrame:
    """Maps of labels in one: of each id the labels of the latest batch."""
    rest = [c for c in maps.columns if c not in (key, order)]
    return maps.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def chunks_of(rows: DataFrame, order: str, size: int = 165) -> DataFrame:
    """``rows`` with ``chunk``: so many to a chunk, in order of a whole number, counted without one sort of all."""
    blocks = with_earlier_blocks(rows.withColumn("__all", F.lit(0)), "__all", order, F.lit(1))
    place = F.row_number().over(W.partitionBy("block").orderBy(order)) - 1 + F.col("before")
    return blocks.withColumn("chunk", F.floor(place / size).cast("long")).drop("__all", "block", "before")


def _batch_plan(sizes: Column, large: Column, capacity: int) -> Column:
    """For each size of ``sizes(n, c)``, largest first: the batch that is open when its files come, how many of them fit
    into it, and how many go into each new one.

    ``large`` files, as large as the capacity, have had batches to themselves.
    """
    row = "struct<n:bigint,batch:bigint,fit:bigint,each:bigint>"
    start = F.struct(F.lit(0).cast("bigint").alias("held"), (large - 1).cast("bigint").alias("batch"), F.lit(False).alias("open"), F.array().cast(f"array<{row}>").alias("rows"))

    def step(a: Column, s: Column) -> Column:
        each = F.when(s.n > 0, F.floor(F.lit(capacity) / s.n)).otherwise(s.c)
        fit = F.when(~a.open, 0).when(s.n == 0, s.c).otherwise(F.least(s.c, F.floor((F.lit(capacity) - a.held) / F.greatest(s.n, F.lit(1)))))
        rest = s.c - fit
        new = F.ceil(rest / each)
        held = F.when(rest > 0, (rest - (new - 1) * each) * s.n).otherwise(a.held + fit * s.n)
        told = F.struct(s.n.cast("bigint").alias("n"), a.batch.alias("batch"), fit.cast("bigint").alias("fit"), each.cast("bigint").alias("each"))
        return F.struct(held.cast("bigint").alias("held"), (a.batch + new).cast("bigint").alias("batch"), F.lit(True).alias("open"), F.concat(a.rows, F.array(told)).alias("rows"))

    return F.aggregate(sizes, start, step, lambda a: a.rows)


def greedy_batches(files: DataFrame, capacity: int = 150) -> DataFrame:
    """(group, batch, files) of (group, name, n): files by size, largest first, put into batches of a capacity.

    A batch closes when the next file does not fit; a file as large as the capacity has one to
    itself. Files of equal size move what a batch holds by a rule that needs their number alone, so a
    group is a fold over at most ``capacity`` sizes, and its files are numbered in ranges: a group of
    any size is spread over many tasks. Files without a size have none; of equal names any comes first.
    """
    sized = files.select("group", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    sized = sized.withColumn("size", F.least("n", F.lit(capacity)))
    counts = sized.groupBy("group", "size").agg(F.count("*").alias("c"))
    small = F.reverse(F.array_sort(F.collect_list(F.when(F.col("size") < capacity, F.struct(F.col("size").alias("n"), "c")))))
    large = F.coalesce(F.sum(F.when(F.col("size") == capacity, F.col("c"))), F.lit(0))
    plan = counts.groupBy(F.col("group").alias("g")).agg(_batch_plan(small, large, capacity).alias("rows")).select("g", F.inline("rows"))
    numbered = with_place(sized, ["group", "size"], [F.desc("n"), F.desc("name")])
    large_ones = numbered.where(F.col("size") == capacity).select("group", "name", F.col("place").alias("batch"))
    met = numbered.where(F.col("size") < capacity).drop("n").join(plan, F.col("group").eqNullSafe(F.col("g")) & (F.col("size") == F.col("n")))
    batch = F.when(F.col("place") < F.col("fit"), F.col("batch")).otherwise(F.col("batch") + 1 + F.floor((F.col("place") - F.col("fit")) / F.col("each")))
    placed = large_ones.union(met.select("group", "name", batch.cast("bigint").alias("batch")))
    return placed.groupBy("group", F.col("batch").cast("int").alias("batch")).agg(F.array_sort(F.collect_list("name")).alias("files"))


def staleness(labels: DataFrame, sources: DataFrame, built: DataFrame) -> DataFrame:
    """(batch, stamp, stale): whether a batch's labels or list of sources differ from what it was built of.

    The stamp is a hash of the ordered (id, label) pairs and of the ordered names of sources; both
    are hashed in 256 blocks of ids first, so that no task holds a whole batch.
    """
    digest = lambda c: F.sha1(F.array_join(F.array_sort(F.collect_list(c)), "\n"))
    block = lambda c: F.substring(F.sha1(F.col(c).cast("binary")), 1, 2).alias("block")
    pair = F.to_json(F.struct("id", F.coalesce("label", F.lit("")).alias("label")))
    ids = labels.groupBy("batch", block("id")).agg(digest(pair).alias("d")).groupBy("batch").agg(digest(F.concat("block", "d")).alias("ids"))
    names = sources.groupBy("batch", block("name")).agg(digest(F.col("name")).alias("d")).groupBy("batch").agg(digest(F.concat("block", "d")).alias("names"))
    stamps = ids.join(names, "batch", "left").select("batch", F.substring(F.sha1(F.concat_ws(":", "ids", F.coalesce("names", F.lit(""))).cast("binary")), 1, 12).alias("stamp"))
    both = stamps.join(built.select("batch", F.col("stamp").alias("old")), "batch", "left")
    return both.select("batch", "stamp", (~F.col("stamp").eqNullSafe(F.col("old"))).alias("stale"))


def rerank_answers(answers: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, place, candidate, score) out of answers (query_id, answer, n) of a model that ranks n candidates.

    A JSON list of {i, s} counts; else a list of numbers and scores; else the candidates stay in
    order, without scores. Candidates that are none are left out.
    """
    as_json = F.from_json(F.regexp_extract("answer", r"(?s)\[.*?\]", 0), "array<struct<i:int,s:double>>")
    listed = r"\[?(\d+)\]?\D{0,6}?(\d{1,2})(?:\s|$)"
    part = lambda k: F.regexp_extract_all("answer", F.lit(listed), F.lit(k))
    as_list = F.zip_with(part(1), part(2), lambda i, s: F.struct(i.cast("int").alias("i"), s.cast("double").alias("s")))
    valid = F.filter(as_json, lambda x: x.i.isNotNull())
    plain = F.transform(F.sequence(F.lit(0), F.least(F.lit(top), F.col("n")) - 1), lambda i: F.struct(i.alias("i"), F.lit(None).cast("double").alias("s")))
    # In JSON the last score of a candidate counts, in a list the first.
    last_first = F.reverse(F.transform(valid, lambda x: F.struct(x.i.alias("i"), F.coalesce(x.s, F.lit(0.0)).alias("s"))))
    found = F.when(F.size(valid) > 0, last_first).when(F.size(as_list) > 0, as_list)
    once = F.filter(found, lambda x, k: ~F.exists(F.slice(found, F.lit(1), k), lambda y: y.i == x.i))
    ranked = F.slice(F.array_sort(once, lambda a, b: F.when(a.s > b.s, -1).when(a.s < b.s, 1).otherwise(a.i - b.i)), 1, top)
    chosen = F.when(F.size(ranked) > 0, ranked).otherwise(plain)
    rows = answers.select("query_id", "n", F.posexplode(chosen).alias("place", "x"))
    return rows.where(F.col("x.i") < F.col("n")).select("query_id", "place", F.col("x.i").alias("candidate"), F.col("x.s").alias("score"))


def manifest_packs(manifests: DataFrame) -> DataFrame:
    """(version, kind, pack_version, base, url, full_url, total_after) of the packs that manifests (text) name; missing ones are left out."""
    pack = "struct<version:string,base:string,url:string,total_after:int,full:struct<url:string>>"
    parsed = manifests.select(F.from_json("text", f"version string, knowledge {pack}, knowledge_regs {pack}").alias("m"))
    kinds = F.array(F.struct(F.lit("cases").alias("kind"), F.col("m.knowledge").alias("p")), F.struct(F.lit("regs").alias("kind"), F.col("m.knowledge_regs").alias("p")))
    rows = parsed.select(F.col("m.version").alias("version"), F.inline(kinds)).where("p IS NOT NULL")
    return rows.select("version", "kind", F.col("p.version").alias("pack_version"), "p.base", "p.url", F.col("p.full.url").alias("full_url"), "p.total_after")


def reconcile_status(source: DataFrame, own: DataFrame) -> DataFrame:
    """``own(file, pos, line)`` with lines that differ from the source's (file, pos, line) in their status alone replaced by them.

    Lines without the status meet by equality; the first of each side meet, then the second, and so on.
    """
    from ..functions.metadata import without_status

    def numbered(df: DataFrame) -> DataFrame:
        return with_place(df.withColumn("key", without_status("line")), ["file", "key"], [F.asc("pos")]).withColumnRenamed("place", "k")

    now = numbered(source).select("file", "key", "k", F.col("line").alias("new"))
    both = numbered(own).join(now, ["file", "key", "k"], "left")
    return both.select("file", "pos", F.coalesce("new", "line").alias("line"), (F.col("new").isNotNull() & (F.col("new") != F.col("line"))).alias("changed"))


def edit_ratio(a: str, b: str) -> float:
    """Twice the characters of the matching blocks of two texts, by the characters of both.

    Blocks are found as the longest one first, then left and right of it; characters that make up more
    than a hundredth of a longer text begin none.
    """
    return SequenceMatcher(None, a, b).ratio()


def similar_enough(a: Column | str, b: Column | str, chars: int = 6000, least: float = 0.5) -> Column:
    """Whether the beginnings of two texts, white space aside, have an edit ratio of ``least`` or more.

    Pairs that cannot reach it, by their lengths or their characters, are told before blocks are looked for.
    """

    @F.pandas_udf("boolean")
    def reach(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s: str | None, t: str | None) -> bool:
            if not s or not t:
                return False
            if 2 * min(len(s), len(t)) < least * (len(s) + len(t)) or 2 * sum((Counter(s) & Counter(t)).values()) < least * (len(s) + len(t)):
                return False
            return edit_ratio(s, t) >= least

        return pd.Series([one(s, t) for s, t in zip(x, y)], dtype=bool)

    return reach(*[F.substring(tx.squeeze(c), 1, chars) for c in (a, b)])
