"""Reports as office files: a sink that writes one docx or xlsx for each row.

``df.write.format("office").mode("append").save(folder)`` takes rows (name, text). The ending of the name says
what becomes of the Markdown in ``text``: headings, paragraphs and tables of a document, or the cells
of a sheet. Tasks write to a folder beside the others; the driver moves the files in place once
all tasks are done, so a task that fails leaves none.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Names and types of the format.
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_MAIN = {
    "docx": ("word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"),
    "xlsx": ("xl/workbook.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"),
}
#: Characters that XML cannot have.
_NONE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def blocks(text: str) -> list[tuple[str, object]]:
    """(kind, content) of Markdown: headings with their level, tables as rows of cells, and paragraphs."""
    out: list[tuple[str, object]] = []
    for line in _NONE.sub("", text).split("\n"):
        line = line.strip()
        if re.fullmatch(r"\|.*\|", line):
            cells = [c.strip() for c in line[1:-1].split("|")]
            if all(re.fullmatch(":?-{3,}:?", c) for c in cells):
                continue
            if out and out[-1][0] == "table":
                out[-1][1].append(cells)
            else:
                out.append(("table", [cells]))
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            out.append((f"Heading{len(m[1])}", m[2]))
        elif line:
            out.append(("text", re.sub(r"\*\*(.+?)\*\*", r"\1", line)))
        else:
            out.append(("", ""))
    return [b for b in out if b[0]]


def _zipped(kind: str, parts: dict[str, str], more: list[tuple[str, str]] = ()) -> bytes:
    main, mime = _MAIN[kind]
    named = "".join(f'<Override PartName="/{name}" ContentType="{m}"/>' for name, m in [(main, mime), *more])
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{named}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>',
    } | parts
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), _XML + body)  # the same bytes for the same text
    return out.getvalue()


def docx(text: str) -> bytes:
    """A document with the headings, paragraphs and tables of a Markdown text."""

    def paragraph(content: str, style: str = "") -> str:
        look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{look}<w:r><w:t xml:space="preserve">{escape(content)}</w:t></w:r></w:p>'

    body = []
    for kind, content in blocks(text):
        if kind == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in content)
            body.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            body.append(paragraph(content, "" if kind == "text" else kind))
    return _zipped("docx", {"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{"".join(body)}</w:body></w:document>'})


def _column(n: int) -> str:
    name = ""
    while n >= 0:
        name, n = chr(65 + n % 26) + name, n // 26 - 1
    return name


def xlsx(text: str) -> bytes:
    """A workbook of one sheet: the rows of tables, and all else in the first column; numbers stay numbers."""
    lines = [row for kind, content in blocks(text) for row in (content if kind == "table" else [[content]])]

    def cell(r: int, c: int, value: str) -> str:
        at = f"{_column(c)}{r}"
        if re.fullmatch(r"-?(0|[1-9]\d{0,14})(\.\d+)?", value):
            return f'<c r="{at}"><v>{value}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    rows = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(lines, 1))
    book = f'<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>'
    rels = f'<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
    parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{rows}</sheetData></worksheet>'}
    return _zipped("xlsx", parts, [("xl/worksheets/sheet1.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml")])


MAKERS = {"docx": docx, "xlsx": xlsx}


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class OfficeWriter(DataSourceWriter):
    """Two phases: tasks write below ``_temporary``, the driver moves what they have written, or deletes it."""

    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), f"_temporary-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, rows: Iterator[Row]) -> Written:
        store, top = self._store()
        folder = f"{top}/{self.run}/{uuid.uuid4().hex}"  # each attempt has its own
        store.create_dir(folder)
        names = []
        for row in rows:
            name, kind = row["name"], row["name"].rpartition(".")[2].lower()
            if kind not in MAKERS or "/" in name or "\\" in name or name.startswith("."):
                raise ValueError(f"no name of an office file: {name}")
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(MAKERS[kind](row["text"] or ""))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = self._store()
        moves = [(f"{m.folder}/{name}", f"{top}/{name}") for m in messages if m for name in m.names]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two rows have one name")
        for source, to in moves:
            store.move(source, to)
        store.delete_dir(f"{top}/{self.run}")

    def abort(self, messages: list[Written | None]) -> None:
        store, top = self._store()
        if store.get_file_info(f"{top}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.run}")


class OfficeFiles(DataSource):
    """The sink ``office``; rows are (name, text)."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def writer(self, schema: StructType, overwrite: bool) -> OfficeWriter:
        if missing := {"name", "text"} - set(schema.fieldNames()):
            raise ValueError(f"columns that are missing: {sorted(missing)}")
        if overwrite:
            raise ValueError("office files are added to a folder; files of the same name are replaced")
        return OfficeWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OfficeFiles)
