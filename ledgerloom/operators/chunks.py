"""Cutting texts into chunks, and other packing in order; each text by itself, in one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paragraphs(text: Column | str) -> Column:
    parts = F.split(text, r"(?=第[一二三四五六七八九十百零0-9]+条)")
    parts = F.when(F.size(parts) < 2, F.split(text, r"\n\s*\n")).otherwise(parts)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def packed(parts: Column, soft: int = 600, hard: int = 900, cut: int = 800) -> Column:
    """Neighbouring parts joined while they stay under ``soft`` characters; those over ``hard`` cut up.

    A fold over the parts: the open chunk and those done. A part that is cut up leaves the open
    chunk as it is.
    """
    empty = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def add(s: Column, p: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / cut).cast("int")), lambda i: F.substring(p, i * cut + 1, F.lit(cut)))
        fits = F.length(s.open) + F.length(p) < soft
        joined = F.when(s.open == "", p).otherwise(F.concat_ws("\n", s.open, p))
        closed = F.when(s.open == "", s.done).otherwise(F.concat(s.done, F.array(s.open)))
        return (
            F.when(F.length(p) > hard, F.struct(s.open.alias("open"), F.concat(s.done, pieces).alias("done")))
            .when(fits, F.struct(joined.alias("open"), s.done.alias("done")))
            .otherwise(F.struct(p.alias("open"), closed.alias("done")))
        )

    return F.aggregate(parts, empty, add, lambda s: F.when(s.open == "", s.done).otherwise(F.concat(s.done, F.array(s.open))))


def chunk(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_no, chunk) of all documents."""
    return docs.select(id_col, F.posexplode(packed(paragraphs("text"))).alias("chunk_no", "chunk"))


def accepted_numbers(numbers: Column, ahead: int = 5) -> Column:
    """Of numbers in order those that go on from the last accepted one, by at most ``ahead``; the first must be 1."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("kept"))

    def add(s: Column, n: Column) -> Column:
        ok = F.when(s.last == 0, n == 1).otherwise((n > s.last) & (n <= s.last + ahead))
        return F.when(ok, F.struct(n.cast("int").alias("last"), F.concat(s.kept, F.array(n.cast("int"))).alias("kept"))).otherwise(s)

    return F.aggregate(numbers, start, add, lambda s: s.kept)


def split_long(text: Column | str, most: int = 700) -> Column:
    """Cuts of at most ``most`` characters, after a sentence past the middle where there is one."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = rf"(?s).{{{most // 2},{most - 2}}}[.;] |.{{1,{most}}}"
    return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda x: F.trim(x))
