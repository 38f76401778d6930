from __future__ import annotations

import re

import pytest

import corpus_pipeline
from ledgerloom.llm import linededup, packing

ODD = [
    (1, "Il testo parla della vita nella citta vecchia e dei suoi abitanti.", "it", "a", 66, "x"),
    (2, None, "it", "a", 0, None),
    (3, "", None, "b", 0, "y"),
    (3, "", None, "b", 0, "y"),
    (4, "12345 67890", "it", "b", 11, "z"),
    (5, "The letter of Ann came to ann@example.org on a cold day in the winter.", "en", "c", 70, "x"),
    (6, "The letter of Ann came to ann@example.org on a cold day in the winter.", "en", "c", 70, "x"),
    (None, "Another text about roads and rivers without any number in it at all.", "en", None, 67, "x"),
]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, dropped string")


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "pii", "packing"]


@pytest.mark.parametrize("k", range(5))
def test_each_stage_takes_odd_rows(spark, tiny, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd(spark)
    got = stage(spark, docs, tiny)
    assert stage(spark, docs.limit(0), tiny).count() == 0
    rows = got.collect()
    if k < 4:
        assert got.columns == docs.columns and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes]
        assert {r["doc_id"] for r in rows} <= {r[0] for r in ODD}
    else:
        assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_id"] == 2) == 1


def test_decisions_take_effect(spark, tiny):
    """Each stage is judged on what the one before it has kept."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, tiny), f"test-{name}")
        after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    languages, lines, near, private = after.values()
    assert all(t and re.search(r"[^\W\d_]", t) for t in languages.values())
    lost = [d for d, t in texts.items() if t and len(re.findall(r"[a-z]{3,}", t)) > 50 and d not in languages]
    assert len(lost) <= 0.01 * len(texts)  # prose stays
    seen: dict[str, int] = {}
    for d in sorted(lines):
        for line in lines[d].split("\n"):
            if len(line.split()) >= linededup.MIN_TOKENS:
                assert seen.setdefault(line, d) == d, line
    assert near.keys() <= lines.keys() and private.keys() == near.keys()
    assert not any(re.search(r"[\w.]+@[\w-]+\.[a-z]{2,}", t) for t in private.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect()
    assert {r["doc_id"] for r in packed} == private.keys()
    assert all(r["offset"] + r["length"] <= packing.WINDOW for r in packed)


def test_run_equals_its_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, tiny), "test")
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, tiny)) == key(docs)
