"""The registered queries over the documents table, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lexicon, linededup, lm, media, packing, periods, pii, prefixtrie, quality, simhash, substrings, tokenstore
from .common import documents, materialize
from .wordpieces import public_path

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), public_path(WORD_BPE), ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tokenstore.write(documents(spark, sf_dir), public_path(WORD_BPE))
    return tokenstore.read(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(media.to_media(documents(spark, sf_dir).select("doc_id", "text")), "media")
    digests = [F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")]
    read = media.tensors(stored, rgb=False)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", *digests, "feature")


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_recurring(documents(spark, sf_dir).select("doc_id", "text"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", lm.held_out())
    model = lm.fit(docs.where(~F.col("held_out")))
    scored = lm.score(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = langid.fold(langid.FOLDS) == langid.HELD_OUT
    model = langid.fit(docs, held_out)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return simhash.components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir).select("doc_id", "text"), public_path(BYTE_BPE)
    both = lexicon.decode(lexicon.encode(docs, path, lexicon.compile_lexicon(docs, path)), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"))


def op11_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.detect(documents(spark, sf_dir).select("doc_id", "text"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_tokenstore": op2_tokenstore,
    "op3_media": op3_media,
    "op4_linededup": op4_linededup,
    "op5_lm": op5_lm,
    "op6_langid": op6_langid,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_prefixtrie": op11_prefixtrie,
    "op12_periods": op12_periods,
    "op13_substrings": op13_substrings,
}
#: SQL for DuckDB; the others cannot be put in SQL and are tested against brute force instead.
ORACLES: dict[str, str] = {
    "op9_quality": quality.oracle_sql(),
    "op11_prefixtrie": prefixtrie.oracle_sql(),
    "op12_periods": periods.oracle_sql(),
    "op13_substrings": substrings.oracle_sql(),
}
