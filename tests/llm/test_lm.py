from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import lm, queries


def slow_words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def test_base_counts_and_scores(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter()
    for d, t in texts.items():
        if not held[d]:
            counts.update([*slow_words(t), ""])
    n, v = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in queries.op5_lm(spark, tiny).collect()}
    assert rows.keys() == texts.keys()
    for d, t in texts.items():
        tokens = [*slow_words(t), ""]
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[d], len(tokens), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n * 1 + 1 * (v + 1))) for w in tokens), rel_tol=1e-9)
    own, base = (sum(rows[d][c] for d in texts if held[d]) for c in ("score", "base_score"))
    assert own > base  # the model says more about unseen texts than word counts do


def test_probabilities_add_up(spark):
    rows = [(i, "the cat sat on the mat and the dog ran to the cat") for i in range(20)] + [(99, "rare words unknown elsewhere")]
    model = lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    size = model.symbols.size
    table = 10 ** model.table.reshape(-1, size).astype(float)
    assert np.allclose(table.sum(1), 1, atol=1e-4)
    # Within a bucket, known words and one share for all unknown ones add up to one.
    counts = {bytes(r["word"]): r["n"] for r in model.counts.collect()}
    for b in range(lm.BUCKETS):
        own = [n for w, n in counts.items() if w not in model.symbols.number and lm.bucket_of(w) == b]
        if own:
            total = 10 ** model.within[model.symbols.first + b]
            assert math.isclose(sum((n + 1) / total for n in own) + 1 / total, 1, rel_tol=1e-9)


def test_training_beats_the_start():
    rng = np.random.default_rng(0)
    grid = np.zeros((7, 7, 6), np.int64)
    grid[rng.integers(0, 7, 400), rng.integers(0, 7, 400), 2] += 50
    grid[:, 3, 5] += 400  # symbol 5 follows symbol 3
    out = lm.train(grid, dims=6, steps=150)
    assert 10 ** out[0, 3, 5] > 0.8 and 10 ** out[0, 1, 2] > 0.8
    assert np.isfinite(lm.train(np.zeros((4, 4, 3), np.int64), dims=2, steps=3)).all()


@pytest.mark.parametrize("dictionary", [1, 1 << 17])
def test_edges(spark, monkeypatch, dictionary):
    monkeypatch.setattr(lm, "DICTIONARY", dictionary)  # with one word, all others take the way over the join
    rows = [(1, None, "a"), (2, "", "b"), (None, "one two two", "c"), (3, "One " * 30_000, "d"), (3, "One " * 30_000, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = lm.fit(frame)
    got = lm.score(frame, model).collect()
    by = {(r["doc_id"], r["n_tokens"]): r for r in got}
    assert len(got) == 5 and by[1, 1]["n_known"] == 1 and by[3, 30_001]["n_known"] == 30_001 and by[None, 4]["n_known"] == 4
    n, v = model.tokens, model.distinct
    want = sum(math.log10((c + 1) / (n + v + 1)) for c in (60_001, 2, 2, 5))
    assert math.isclose(by[None, 4]["base_score"], want, rel_tol=1e-9)
    assert lm.score(frame.limit(0), model).count() == 0
    nothing = lm.fit(frame.limit(0))
    assert all(np.isfinite(r["score"]) for r in lm.score(frame, nothing).collect())


def test_scores_equal_a_plain_sum_over_tokens(spark, tiny, monkeypatch):
    """Token by token from the model's tables, with the shares of rare words counted anew."""
    monkeypatch.setattr(lm, "LEAST_COUNT", 5)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    model = lm.fit(docs.where("doc_id % 3 > 0"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = Counter()
    for d, t in texts.items():
        if d % 3:
            counts.update(w.encode() for w in slow_words(t))
    sy = model.symbols
    assert sy.first > 200 and len(sy.class_of) == sy.words == sy.first + lm.BUCKETS
    left = Counter()
    for w, n in counts.items():
        if w not in sy.number:
            left[lm.bucket_of(w)] += n + 1
    for d, t in texts.items():
        two = one = sy.size
        before, total = sy.words, 0.0
        for w in [*(x.encode() for x in slow_words(t)), b""]:
            own = sy.number.get(w)
            number = sy.first + lm.bucket_of(w) if own is None else own
            c = int(sy.class_of[number])
            total += float(model.table[(two * (sy.size + 1) + one) * sy.size + c]) + float(model.pairs[before, number])
            if own is None:
                total += math.log10((counts[w] + 1) / (left[lm.bucket_of(w)] + 1))
            two, one, before = one, c, number
        texts[d] = total
    rows = lm.score(docs, model).collect()
    assert len(rows) == len(texts) and all(math.isclose(r["score"], texts[r["doc_id"]], rel_tol=1e-5, abs_tol=1e-4) for r in rows)
    shares = 10 ** model.pairs.astype(float)
    for b in range(lm.BUCKETS):
        assert np.allclose(shares[:, sy.members(b)].sum(1), 1, atol=1e-4)
    assert (shares[:, : sy.single] == 1).all()


def test_pairs_are_learned():
    counts = np.zeros((6, 4), np.int64)
    counts[0, 1], counts[1, 2], counts[2] = 500, 500, 100
    out = 10 ** lm.train_pairs(counts, seed=1)
    assert out[0, 1] > 0.8 and out[1, 2] > 0.8 and np.allclose(out.sum(1), 1, atol=1e-5)
    assert np.allclose(out[3], out[4]) and out[3, 3] < out[3, 1]  # never seen: the shares
    assert np.isfinite(lm.train_pairs(np.zeros((3, 2), np.int64), seed=1)).all()
