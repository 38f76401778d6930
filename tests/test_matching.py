"""Passages in documents and words in capabilities, against plain comparison of texts."""

from __future__ import annotations

import random
import time

import pytest

from ledgerloom.operators import documents, matching, teams


def even(text):
    return " ".join((text or "").lower().split())


@pytest.mark.parametrize("most", [10**6, 3])
def test_contained_equals_plain_search(spark, most):
    rng = random.Random(most)
    words = ["a", "b", "c", "Ö", "dd"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)] + [(50, None), (51, ""), (None, "a b\n c  DD"), (3, "again a b c")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(120)] + [(200, None), (201, " "), (202, "A\tb")]
    items += [(300 + i, " ".join((docs[i][1] or "").split()[2:-3])) for i in range(40)]  # long passages
    found = documents.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most)
    want = {(d, i) for d, t in docs for i, p in items if even(p) and f" {even(p)} " in f" {even(t)} "}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_exchange_carries_a_text(spark):
    docs, items = spark.createDataFrame([(1, "x y z")], "doc_id long, text string"), spark.createDataFrame([(1, "y z")], "item_id long, text string")
    for most in (10, 0):
        frame = documents.contained(docs, items, most)
        assert [tuple(r) for r in frame.collect()] == [(1, 1)]
        plan = frame._jdf.queryExecution().executedPlan()
        text = plan.toString().split("Initial Plan")[0]
        for line in text.split("\n"):
            if "Exchange" in line:
                assert "text" not in line


def test_long_document_takes_linear_time():
    words = [b"%d" % (k % 977) for k in range(200_000)]  # about 1 MB
    table = {c: [] for c in matching._ENDS}
    for n in (1, 5, 64, 500, 100_000):
        sequence = matching.word_sequence(words[7 : 7 + n])
        import numpy as np

        first, last = sequence.hashes(np.zeros(1, np.int64), matching.half(n)), sequence.hashes(np.array([n - matching.half(n)]), matching.half(n))
        for c, v in zip(matching._ENDS, (n, first[0][0], first[1][0], last[0][0], last[1][0])):
            table[c].append(int(v))
    import pyarrow as pa

    run = matching._in_place({c: np.array(v, np.int64) for c, v in table.items()})
    began = time.perf_counter()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b" ".join(words).decode()])], names=["doc_id", "text"])
    assert sorted(pa.Table.from_batches(list(run([batch]))).column("n").to_pylist()) == [1, 5, 64, 500, 100_000]
    assert time.perf_counter() - began < 20


AGENTS = "pos long, name string, capability string, executor string"


def test_capability_of_any_length(spark):
    long = "".join(random.Random(1).choices("abcdefghij", k=3000))
    agents = [(1, "A", f"law {long} tax", "external"), (2, "B", f"x{long[500:]}", "builtin"), (3, "C", "Steuer-Recht 税务筹划", "builtin"), (4, "D", None, "builtin")]
    tasks = [(1, f"about {long[600:1900]}", ""), (2, long[100:1000], ""), (3, "recht und mehr", ""), (4, "筹划", ""), (5, "nobody", ""), (6, long + "q", ""), (7, "x a", ""), (8, None, None)]
    got = {r["task_id"]: r["owner"] for r in teams.match_owner(spark.createDataFrame(tasks, "task_id long, title string, hint string"), spark.createDataFrame(agents, AGENTS)).collect()}
    assert got == {1: "B", 2: "A", 3: "C", 4: "C", 5: "B", 6: "B", 7: "B", 8: "B"}


def test_capabilities_equal_plain_search(spark):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choices("ab\U0001f642", k=k))
    agents = [(p, f"n{p}", " ".join(word(rng.randint(1, 12)) for _ in range(3)), rng.choice(["builtin", "external"])) for p in range(25)]
    tasks = [(t, " ".join(word(rng.randint(1, 7)) for _ in range(2)), "") for t in range(80)]
    best = {}
    for t, title, _ in tasks:
        rows = [(1 if x == "builtin" else 3, p, n) for p, n, c, x in agents if any(len(w) > 1 and w in v for w in title.split() for v in c.split())]
        best[t] = min(rows)[2] if rows else next(n for p, n, c, x in agents if x == "builtin")
    got = {r["task_id"]: r["owner"] for r in teams.match_owner(spark.createDataFrame(tasks, "task_id long, title string, hint string"), spark.createDataFrame(agents, AGENTS)).collect()}
    assert got == best
