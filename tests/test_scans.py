"""Folds that are cut into blocks, against the same folds in one piece."""

from __future__ import annotations

import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import catalogue as cat
from ledgerloom.operators import review
from ledgerloom.operators.running import with_place


def plain_batches(files, capacity):
    out = defaultdict(list)
    for group in {g for g, _, _ in files}:
        batches, now, held = [], [], 0
        for n, name in sorted(((n or 0, name) for g, name, n in files if g == group), reverse=True):
            if n >= capacity or held + n > capacity:
                if now:
                    batches.append(now)
                if n >= capacity:
                    batches.append([name])
                    now, held = [], 0
                    continue
                now, held = [name], n
            else:
                now.append(name)
                held += n
        out[group] = batches + [now] * bool(now)
    return {(g, k): sorted(names) for g, x in out.items() for k, names in enumerate(x)}


@pytest.mark.parametrize("capacity", [1, 7, 150])
def test_batches_equal_plain_fold(spark, capacity):
    rng = random.Random(capacity)
    files = [(rng.choice(["a", "b", "hot", None]), f"f{k:04d}", rng.choice([0, 1, 2, 3, 40, 75, 149, 150, 151, 400, rng.randrange(160)])) for k in range(700)]
    files += [("zeros", f"z{k}", rng.choice([0, None])) for k in range(20)]
    got = cat.greedy_batches(spark.createDataFrame(files, "group string, name string, n int").repartition(7), capacity)
    assert {(r["group"], r["batch"]): r["files"] for r in got.collect()} == plain_batches(files, capacity)
    assert cat.greedy_batches(spark.createDataFrame([], "group string, name string, n int"), capacity).count() == 0


def test_place_in_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), k) for k in range(2000)]
    got = with_place(spark.createDataFrame(rows, "k string, o int, id long"), ["k"], [F.desc("o"), F.asc("id")]).collect()
    for key in ("hot", "b", None):
        own = sorted((r for r in got if r["k"] == key), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert [(r["o"], r["id"]) for r in own] == sorted(((o, i) for k, o, i in rows if k == key), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 16])
def test_versions_equal_plain_fold(spark, block):
    rng, rows, want = random.Random(block), [], {}
    for task in ("a", "b", "c", None):
        version, seqs = 0, sorted(rng.sample(range(1, 2000), 300))
        for seq in seqs:
            near = version + rng.choice([-1, 0, 0, 0, 1, 2])
            expected = rng.choice([None, near, near, rng.randrange(200)]) if task != "c" else None
            rows.append((task, seq, "x", expected))
            fits = expected is None or expected == version
            if task in ("a", "b"):
                want[task, seq] = (version, fits)
            version += fits
    got = review.versioned(spark.createDataFrame(rows, "task_id string, log_seq long, to string, expected_version long"), block).collect()
    assert {(r["task_id"], r["log_seq"]): (r["version"], r["accepted"]) for r in got} == want
    assert any(not fits for _, fits in want.values()) and any(v > 20 for v, _ in want.values())


def plain_ratio(a, b):
    """Matching blocks by trying all pairs of places; frequent characters of a longer text begin no block."""
    seldom = {c for c in b if len(b) < 200 or b.count(c) <= len(b) // 100 + 1}

    def size(alo, ahi, blo, bhi):
        best = (0, alo, blo)
        for i in range(alo, ahi):
            for j in range(blo, bhi):
                if a[i] == b[j] and a[i] in seldom:
                    k = 0
                    while i + k < ahi and j + k < bhi and a[i + k] == b[j + k] and a[i + k] in seldom:
                        k += 1
                    if k > best[0]:
                        best = (k, i, j)
        k, i, j = best
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            k, i, j = k + 1, i - 1, j - 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        return k and k + size(alo, i, blo, j) + size(i + k, ahi, j + k, bhi)

    return 2 * size(0, len(a), 0, len(b)) / (len(a) + len(b)) if a or b else 1.0


def test_edit_ratio_is_that_of_matching_blocks(spark):
    rng, pairs = random.Random(2), []
    for _ in range(1500):
        a = "".join(rng.choices("abcde税", k=rng.randint(1, 40)))
        b = "".join(c for c in a if rng.random() < 0.7) + "".join(rng.choices("abcxy", k=rng.randint(0, 20)))
        pairs.append((a, b or "z"))
    pairs += [("税" * 300 + "abc" * 9, "税" * 250 + "abd" * 9), ("x" * 10, ""), ("", "")]
    for a, b in pairs[:1501]:
        assert abs(cat.edit_ratio(a, b) - plain_ratio(a, b)) < 1e-12
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", cat.similar_enough("a", "b").alias("is")).collect()
    for r in got:
        assert r["is"] == bool(r["a"] and r["b"] and SequenceMatcher(None, r["a"], r["b"]).ratio() >= 0.5)
    assert 100 < sum(r["is"] for r in got) < 1490
