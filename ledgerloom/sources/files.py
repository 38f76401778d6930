"""Files as tables: event logs in JSON lines, Markdown corpora, transfer letters, office documents.

Spark lists and reads the files; only the unzipping of office documents runs in Python, one file
at a time within its task.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import EVENT

#: Kinds of material that are taken in, and the limits of one.
TEXT_KINDS = ["txt", "md", "json", "csv"]
OFFICE_KINDS = ["docx", "pptx", "xlsx"]
IMAGE_KINDS = ["png", "jpg", "jpeg"]
MOST_BYTES, MOST_CHARS, MOST_VALUES = 20 * 1024 * 1024, 200_000, 80


def read_events(spark: SparkSession, path: str | list[str], project_id: str | None = None, task_id: str | None = None) -> DataFrame:
    """A log of JSON lines; lines that are none are skipped, and an empty filter means no filter."""
    rows = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).where("event_type IS NOT NULL")
    for name, value in (("project_id", project_id), ("task_id", task_id)):
        if value:
            rows = rows.where(F.col(name) == value)
    return rows


def read_events_jdbc(spark: SparkSession, url: str, table: str = "events", partitions: int = 16, **properties: str) -> DataFrame:
    """A log from a database table (id, event_type ... created_at, payload as JSON text), read in ranges of ids at once.

    The database is asked for the least and greatest id once; filters on plain columns go to it.
    """
    key = next(c for c in spark.read.jdbc(url, table, properties=properties).columns if c.lower() == "id")
    bounds = spark.read.jdbc(url, f'(SELECT min("{key}") AS lo, max("{key}") AS hi FROM {table}) b', properties=properties).first()
    lo, hi = (int(x) if x is not None else 0 for x in bounds)
    rows = spark.read.jdbc(url, table, column=key, lowerBound=lo, upperBound=hi + 1, numPartitions=min(partitions, max(1, hi - lo + 1)), properties=properties)
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    at = (F.unix_micros("created_at") / 1e6).alias("created_at_ts")
    plain = ["event_type", "actor", "project_id", "task_id", "user_id", "idempotency_key"]
    return rows.select(F.col("id").cast("bigint").alias("log_seq"), *plain, at, F.from_json("payload", EVENT["payload"].dataType).alias("payload"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, topic, source, fields, text, body) of all Markdown files below a folder, in the order of their paths.

    A file that cannot be read is skipped and stops nothing.
    """
    files = spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    # Every field of the head, the first value of each; the common ones as columns of their own.
    rows = rows.withColumn("fields", tx.front_fields("text"))
    fields = [tx.front_matter("text", k).alias(k) for k in ("title", "topic", "source")]
    return rows.select("path", *fields, "fields", "text", tx.body("text").alias("body")).orderBy("path")


def read_letters(spark: SparkSession, path: str) -> DataFrame:
    """(path, transfer_id, target_task, created_ts) of transfer letters; the file's own time stands in for a missing one."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    line = lambda name: F.regexp_extract("value", rf"(?m)^{name}:\s*(.*?)\s*$", 1)
    given = F.from_json(line("transfer"), "transfer_id string, target_project string, target_task string, payload string")
    written = F.unix_timestamp(F.try_to_timestamp(line("created_at"), F.lit("yyyy-MM-dd'T'HH:mm:ssZ"))).cast("double")
    rows = files.select(F.col("_metadata.file_path").alias("path"), given.alias("t"), F.coalesce(written, F.unix_timestamp("_metadata.file_modification_time").cast("double")).alias("created_ts"))
    return rows.where("t.transfer_id IS NOT NULL").select("path", "t.transfer_id", "t.target_project", F.col("t.target_task").alias("task_id"), "created_ts")


def _paragraphs(xml: bytes) -> list[str]:
    """Texts of the paragraphs of a part, runs joined."""
    local = lambda e: e.tag.rpartition("}")[2]
    found = ("".join(t.text or "" for t in p.iter() if local(t) == "t") for p in ET.fromstring(xml).iter() if local(p) == "p")
    return [x for x in found if x.strip()]


def _sheet_rows(xml: bytes, shared: list[str]) -> list[str]:
    rows: dict[str, list[str]] = {}
    local = lambda e: e.tag.rpartition("}")[2]
    for c in (e for e in ET.fromstring(xml).iter() if local(e) == "c"):
        value = "".join(e.text or "" for e in c.iter() if local(e) in ("v", "t"))
        if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
            value = shared[int(value)]
        if value:
            rows.setdefault(re.sub("[A-Z]", "", c.get("r") or ""), []).append(value)
    return [",".join(cells) for cells in rows.values()]


def office_text(kind: str, data: bytes) -> str:
    """The text of a docx, pptx or xlsx file, in its own order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if kind == "docx":
            parts = [n for n in names if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml", n)]
            parts.sort(key=lambda n: (n != "word/document.xml", n))
            return "\n".join(x for n in parts for x in _paragraphs(z.read(n)))
        number = lambda n: int(re.sub(r"\D", "", n) or 0)
        if kind == "pptx":
            parts = [n for n in names if re.fullmatch(r"ppt/(slides/slide|notesSlides/notesSlide|diagrams/data|diagrams/drawing)\d+\.xml", n)]
            texts = [x for n in sorted(parts, key=lambda n: (number(n), n)) for x in _paragraphs(z.read(n))]
            for n in sorted(n for n in names if re.fullmatch(r"ppt/charts/[^/]*\.xml", n)):
                values = [e.text for e in ET.fromstring(z.read(n)).iter() if e.tag.rpartition("}")[2] == "v" and e.text]
                texts += ["[图表数据] " + ", ".join(values[:MOST_VALUES])] if values else []
            return "\n".join(texts)
        shared = []
        if "xl/sharedStrings.xml" in names:
            local = lambda e: e.tag.rpartition("}")[2]
            items = (e for e in ET.fromstring(z.read("xl/sharedStrings.xml")).iter() if local(e) == "si")
            shared = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in items]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number)
        return "\n".join(x for n in sheets for x in [f"[{n.rpartition('/')[2][:-4]}]", *_sheet_rows(z.read(n), shared)])


def materials(files: DataFrame) -> DataFrame:
    """``files(name, content)``, perhaps with project_id, as records: material_id, ext, size, refs, text, text_len and note.

    Refused are kinds and sizes beyond the limits, and names with a path or a leading dot. The id is
    of project, name and size, so an upload that comes again is the same material. A file that
    cannot be read has no text, no ``text_ref`` and a note that says so; one bad file stops nothing.
    """
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    safe = ~F.col("name").contains("..") & ~F.col("name").contains("/") & ~F.contains("name", F.lit("\\")) & ~F.col("name").startswith(".")
    files = files if "project_id" in files.columns else files.withColumn("project_id", F.lit(""))
    rows = files.where(safe).withColumn("ext", ext).withColumn("size", F.octet_length("content").cast("long"))
    rows = rows.where(F.col("ext").isin(TEXT_KINDS + OFFICE_KINDS + IMAGE_KINDS + ["pdf"]) & (F.col("size") <= MOST_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, data in zip(batch.column("ext").to_pylist(), batch.column("content").to_pylist()):
                try:
                    text = data.decode("utf-8", "replace") if kind in TEXT_KINDS else office_text(kind, data) if kind in OFFICE_KINDS else ""
                    note = "" if kind in TEXT_KINDS + OFFICE_KINDS else "no text is taken from this kind"
                except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
                    text, note = "", f"unreadable: {type(e).__name__}"
                out.append((text[:MOST_CHARS], note))
            keep = [n for n in batch.schema.names if n != "content"]
            more = [pa.array([x[i] for x in out], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *more], names=[*keep, "text", "note"])

    schema = ", ".join([*[f"`{n}` {t}" for n, t in rows.dtypes if n != "content"], "text string, note string"])
    made = F.sha2(F.concat_ws(":", F.coalesce("project_id", F.lit("")), "name", F.col("size").cast("string")).cast("binary"), 256)
    done = rows.withColumn("material_id", F.substring(made, 1, 12)) if "material_id" not in rows.columns else rows
    schema = ", ".join([*[f"`{n}` {t}" for n, t in done.dtypes if n != "content"], "text string, note string"])
    told = done.mapInArrow(run, schema).withColumn("text_len", F.length("text"))
    stem = F.concat(F.lit("project_inputs/"), F.coalesce("project_id", F.lit("")), F.lit("_"), "material_id")
    text_ref = F.when(F.regexp_replace("text", r"\s", "") != "", F.concat(stem, F.lit(".txt")))
    return told.withColumn("orig_ref", F.concat(stem, F.lit("_"), "name")).withColumn("text_ref", text_ref)


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    """``materials`` of all files in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return materials(files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content"))


def write_buckets(clauses: DataFrame, path: str, by: list[str]) -> None:
    """Clauses as Parquet, a folder for each bucket; only the buckets that are written are replaced."""
    clauses.repartition(*by, F.pmod(F.xxhash64(*[c for c in clauses.columns if c not in by]), F.lit(8))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*by).parquet(path)


def markdown_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, cells) of the Markdown tables in texts; rows that only separate are left out.

    A table is a run of lines that begin with a bar; a row's number counts within its text.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line")).withColumn("line", F.trim("line"))
    bars = lines.where(F.col("line").startswith("|"))
    order = W.partitionBy("doc_id").orderBy("row_no")
    island = F.col("row_no") - F.row_number().over(order)
    numbered = bars.withColumn("island", island)
    numbered = numbered.withColumn("table_no", F.dense_rank().over(W.partitionBy("doc_id").orderBy("island")))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return numbered.where(~F.col("line").rlike(r"^\|[\s:|-]+$")).select("doc_id", "table_no", "row_no", cells.alias("cells"))


def read_ledgers(spark: SparkSession, paths: list[str], agent: str | None = None) -> DataFrame:
    """JSON lines of several folders with the file each comes from; of one agent only if one is named."""
    rows = spark.read.option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(paths).select("*", F.col("_metadata.file_path").alias("path"))
    return rows.where(F.col("agent") == agent) if agent else rows


def read_clauses(spark: SparkSession, path: str, taxes: list[str] | None = None, events: list[str] | None = None) -> DataFrame:
    """(batch, kind, bucket, line_no, line) of clause lines in ``batch/kind/bucket.md`` files below a folder.

    Folders that begin with a point or an underscore are left out. ``taxes`` and ``events`` restrict
    the buckets; which files are read is known from their paths.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumn("p", F.split("_metadata.file_path", "/"))
    at = lambda k: F.url_decode(F.element_at("p", -k))
    rows = files.select(at(3).alias("batch"), at(2).alias("kind"), F.regexp_replace(at(1), r"\.md$", "").alias("bucket"), "value")
    rows = rows.where(~F.col("batch").rlike("^[._]") & ~F.col("kind").rlike("^[._]"))
    if taxes is not None or events is not None:
        rows = rows.where(F.col("bucket").isin([*(taxes or []), *(events or [])]))
    lines = rows.select("batch", "kind", "bucket", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return lines.where(F.startswith("line", F.lit("- ")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, taxes, rules, subjects, semantic) out of JSON files that map an id to labels; the last file by name counts. For ``clauses.overlay``.

    A label that a file does not give is null. One file is read in one piece; a folder of them in parallel.
    """
    labels = "struct<taxes:array<string>,rules:array<string>,subjects:array<string>>"
    texts = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = texts.select("file", F.explode(F.from_json("value", f"map<string,{labels}>")).alias("id", "l"))
    last = rows.groupBy("id").agg(F.max_by("l", "file").alias("l"))
    return last.select("id", "l.*", F.lit(True).alias("semantic"))


def clauses_to_judge(clauses: DataFrame, least: int = 12) -> DataFrame:
    """Clauses with a unit, and those without that are long enough to say something."""
    return clauses.where((F.coalesce("unit", F.lit("")) != "") | (F.length("text") >= least))


def dump_clauses(clauses: DataFrame, path: str) -> None:
    """``clauses_to_judge`` as JSON lines."""
    clauses_to_judge(clauses).write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A table of vectors, written whole, with a folder for each language."""
    vectors.write.mode("overwrite").partitionBy("lang").parquet(path)


def read_vectors(spark: SparkSession, path: str, lang: str | None = None, skip_broken: bool = True) -> DataFrame:
    """Vectors of one language, or of all; only that language's files are read. Broken files are skipped."""
    rows = spark.read.option("ignoreCorruptFiles", skip_broken).parquet(path)
    return rows.where(F.col("lang") == lang) if lang else rows


#: Characters that a file name cannot have, and the fields that a published shard may have.
BAD_NAME = r'[/\\:*?"<>|\s]+'
PUBLIC_FIELDS = ["file", "title", "type", "topic", "snippet"]


def file_name(title, cut: int = 80):
    """A title as the name of a file."""
    return F.substring(F.regexp_replace(F.regexp_replace(title, BAD_NAME, "_"), "^_+|_+$", ""), 1, cut)


def check_public(shard: DataFrame, allowed: list[str] = PUBLIC_FIELDS) -> DataFrame:
    """The shard itself; a field beside those that may be published stops it."""
    if extra := sorted(set(shard.schema["meta"].dataType.names) - set(allowed)):
        raise ValueError(f"fields that must not be published: {extra}")
    return shard
