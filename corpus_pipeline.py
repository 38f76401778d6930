"""The training-data pipeline over the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import langid, linededup, packing, pii, simhash, similar
from ledgerloom.llm.common import clean, documents, materialize, written
from ledgerloom.llm.queries import WORD_BPE
from ledgerloom.llm.wordpieces import public_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of two that cannot be told apart, go.

    Null texts and those without a letter have no language. Repeated rows are judged alike.
    """
    return langid.reject_unknown(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs go, but for the first; documents with nothing else go as well.

    The first is that in the smallest doc_id, null ids last. Null and empty texts have no lines and stay.
    """
    return linededup.keep_new(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its sequences of five words stays.

    That is the one with the smallest doc_id, null ids last; of repeated rows one. Texts without a
    word, null ones too, are one group.
    """
    return simhash.deduplicate(docs, similar.components)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts get pseudonyms under the session's key; null and empty texts stay as they are."""
    return pii.pseudonymize_all(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, placed in sequences; null and empty texts are one end id."""
    return packing.pack(docs, public_path(WORD_BPE))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii", pseudonyms),
    ("packing", pack),
]

#: Classifiers, keyed permutations and tokenizers cannot be put in SQL; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to packed sequences. What a stage has written on its way is deleted once the next one has been written."""
    docs, start = documents(spark, sf_dir), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clean(spark, start)
    return STAGES[-1][1](spark, docs, sf_dir)
