"""Regulations as they are delivered: one text for each tax and topic, without what has been repealed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters that a delivered name cannot have, a name for nothing, and whom a line says it is for.
BAD = r'[\\/:*?"<>|\x00-\x1f]'
UNNAMED, SCOPE = "未命名", "〔仅适用：([^〕]+)〕"


def clean_name(name: Column | str, most: int = 90) -> Column:
    """A name without characters that files cannot have, and without points and spaces at its ends."""
    plain = F.regexp_replace(F.regexp_replace(name, BAD, "_"), r"^[\s.]+|[\s.]+$", "")
    return F.substring(F.coalesce(F.nullif(plain, F.lit("")), F.lit(UNNAMED)), 1, most)


def without_repealed_lines(lines: DataFrame, repealed: DataFrame) -> DataFrame:
    """``lines(tax, topic, line_no, line)`` without clauses that are only for a document in ``repealed(doc)``.

    Lines meet the list by the documents that they name; all others never leave their task.
    """
    keyed = lines.withColumn("scopes", F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(SCOPE), F.lit(1)), lambda x: F.trim(x))))
    clause = F.startswith("line", F.lit("- "))
    named = keyed.where(clause & (F.size("scopes") > 0)).select("tax", "topic", "line_no", F.explode("scopes").alias("doc"))
    gone = named.join(repealed.select("doc").distinct(), "doc", "left_semi").select("tax", "topic", "line_no").distinct()
    return keyed.join(gone, ["tax", "topic", "line_no"], "left_anti").drop("scopes")


def deliveries(lines: DataFrame, repealed: DataFrame) -> DataFrame:
    """(tax, name, text, n_clauses): the texts to deliver, with a head that says what each is.

    A title line that a file begins with goes. A text without any clause left is not delivered.
    Topics whose names become the same are numbered in the order of the topics: name, name（2） ...
    """
    kept = without_repealed_lines(lines, repealed)
    first = (F.col("line_no") == 0) & F.startswith("line", F.lit("# "))
    rows = F.transform(F.array_sort(F.collect_list(F.when(~first, F.struct("line_no", "line")))), lambda x: x.line)
    texts = kept.groupBy("tax", "topic").agg(F.array_join(rows, "\n").alias("body"), F.count_if(F.startswith("line", F.lit("- "))).alias("n_clauses")).where("n_clauses > 0")
    named = texts.withColumn("base", clean_name("topic"))
    # A tax has as many topics as there are files, so one window over each is small.
    k = F.row_number().over(W.partitionBy("tax", "base").orderBy("topic"))
    name = F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("（"), k.cast("string"), F.lit("）")))
    head = F.concat(F.lit("---\ntitle: "), "topic", F.lit("\ntype: 法规\ntax: "), "tax", F.lit("\ntopic: "), "topic", F.lit("\n---\n\n"))
    body = F.regexp_replace("body", r"^\n+|\n+$", "")
    return named.select("tax", name.alias("name"), F.concat(head, body, F.lit("\n")).alias("text"), "n_clauses")


def lost_clauses(lines: DataFrame, repealed: DataFrame, delivered: DataFrame) -> DataFrame:
    """One row (n_in, n_repealed, n_out): clauses given, repealed and delivered; the last two have to make up the first."""
    clause = F.startswith("line", F.lit("- "))
    given = lines.agg(F.count_if(clause).alias("n_in"))
    kept = without_repealed_lines(lines, repealed).agg(F.count_if(clause).alias("n_kept"))
    out = delivered.agg(F.coalesce(F.sum("n_clauses"), F.lit(0)).alias("n_out"))
    both = given.crossJoin(F.broadcast(kept)).crossJoin(F.broadcast(out))  # one row each
    return both.select("n_in", (F.col("n_in") - F.col("n_kept")).alias("n_repealed"), "n_out")


def write_delivery(delivered: DataFrame, path: str) -> None:
    """The texts, a folder for each tax; what an earlier delivery had beside them goes."""
    delivered.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("tax").json(path)
