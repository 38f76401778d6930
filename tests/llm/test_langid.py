"""The sample that language ID learns from, in tables with very many copies."""

from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import langid, queries


@pytest.mark.parametrize("salt", range(3))
def test_sample_is_bounded_and_leaves_no_language_out(spark, monkeypatch, salt):
    rows = [(i, f"copied words of one text {salt}", "en") for i in range(3000)]
    rows += [(5000 + i, f"ein einziger deutscher Satz {salt}", "de") for i in range(3000)]
    rows += [(9000, "un solo testo italiano", "it"), (9001, "123", "xx")]
    seen = Counter()
    train = langid._train

    def spy(x, y, languages, **more):
        seen.update(languages[k] for k in y)
        return train(x, y, languages, **more)

    monkeypatch.setattr(langid, "_train", spy)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=90)
    assert model.languages == ["de", "en", "it"] and seen == {"de": 30, "en": 30, "it": 1}


def plain_answer(model, text):
    """Grams counted one by one, bits decoded language by language."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    letters = []
    for byte in f" {text.lower()} ".encode():
        byte = byte if chr(byte).isascii() and chr(byte).isalpha() or byte >= 128 else 32
        if byte != 32 or not letters or letters[-1] != 32:
            letters.append(byte)
    counts = Counter()
    for k in range(len(letters)):
        one = letters[k]
        grams = [one]
        if k + 1 < len(letters):
            grams.append(one * 257 + letters[k + 1] + (1 << 20))
        if k + 2 < len(letters):
            grams.append((one * 257 + letters[k + 1]) * 257 + letters[k + 2] + (1 << 25))
        counts.update((g * 2654435761 % (1 << 32)) >> 20 for g in grams)
    total = sum(counts.values())
    bits = [sum(math.sqrt(n / total) * float(model.weights[g, b]) for g, n in counts.items()) + 0.1 * float(model.weights[-1, b]) for b in range(model.code.shape[1])]
    loss = [sum(math.log1p(math.exp(-float(c) * f)) * float(t) for c, f, t in zip(row, bits, model.trust)) for row in model.code]
    odds = [math.exp(-(x - min(loss)) * len(bits)) for x in loss]
    best = max(range(len(odds)), key=lambda k: odds[k])
    return model.languages[best], odds[best] / sum(odds)


def test_query_equals_the_plain_version_on_the_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, langid.fold(langid.FOLDS) == langid.HELD_OUT)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op6_langid(spark, tiny).collect()
    assert len(rows) == len(texts)
    for r in rows:
        name, score = plain_answer(model, texts[r["doc_id"]])
        assert r["lang_pred"] == name and math.isclose(r["score"], score, rel_tol=1e-3, abs_tol=1e-4)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "12 3", "x"), (2, "a" * 100_000, "x"), (2, "a" * 100_000, "x")], "doc_id long, text string, lang_pred string")
    assert langid.fit(docs.withColumnRenamed("lang_pred", "lang").limit(0)) is None
    model = langid.fit(spark.createDataFrame([(1, "plain words", "en"), (2, "einfache Wörter", "de")], "doc_id long, text string, lang string"))
    rows = langid.identify(docs, model).collect()
    assert sorted(r["lang_pred"] == "und" for r in rows) == [False, False, True, True, True] and rows[0].asDict().keys() == {"doc_id", "lang_pred", "score", "ambiguous"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_driver_holds_the_sample_once(spark, monkeypatch):
    rows = [(i, f"{w} {i} {w[::-1]}", w[:2]) for i in range(1000) for w in ("english words", "deutsche Wörter")]
    shapes, train = [], langid._train
    monkeypatch.setattr(langid, "_train", lambda x, *more: shapes.append(x.shape) or train(x, *more, steps=3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        model, most = langid.fit(docs), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert shapes[0][0] == 2000 and model.languages == ["de", "en"]
    assert most < 1.7 * 2000 * langid.BUCKETS * 4
