"""The prefix trie, periodic runs and repeated passages, held against plain versions and their SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import periods, prefixtrie, queries, substrings


@pytest.mark.parametrize("name", ["op11_prefixtrie", "op12_periods", "op13_substrings"])
def test_query_equals_sql(spark, tiny, name):
    con = duckdb.connect()
    for f in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = queries.QUERIES[name](spark, tiny)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = cursor.fetchall()
    assert want and sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want, key=repr)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        lender = int(c / 100) * 100
        built[c] = turns.get(lender, [])[:h] + x[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, found in members.items():
        ends = sorted(c for c in found if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(found), len(node), parent, len(found), len(kids[node]), leaves[node], saved[node], sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block, piece", [(4, 8), (7, 16), (prefixtrie.BLOCK, prefixtrie.PIECE)])
def test_trie_equals_plain_version(spark, block, piece):
    rng = random.Random(block)
    rows = []
    for conv in [*rng.sample(range(420), 150), -250, -200, 7001, 10**14]:
        for turn in range(rng.choice([1, 2, 3, 9, 14])):  # some are shorter than what they borrow, or have no lender
            rows.append((conv, None if turn == 0 and rng.random() < 0.3 else turn, rng.choice(["user", None]), rng.choice(["x", "yy", None, "ß🙂"])))
    rows += [(500 + k, t, "user", "same") for k in range(30) for t in range(30)]  # copies, longer than a block
    rows += [(600, t, "user", f"{t // 40}") for t in range(90)] + [(None, 1, "user", "of no conversation")]
    got = prefixtrie.trie(spark.createDataFrame(rows, TURNS).repartition(5), block, piece)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS + ", part string, k1 int")
    assert prefixtrie.trie(empty).collect() == []
    # 3 borrows from 0, which is not there; all that is left of it is a root.
    assert zlib.crc32(b"3") % 6 > 0
    row = prefixtrie.trie(spark.createDataFrame([(3, 1, "user", "x")], TURNS)).collect()
    assert [tuple(r) for r in row] == [(3, 0, None, 1, 0, 1, 0, sha("3"))]
    # Repeated rows are turns like others.
    again = prefixtrie.trie(spark.createDataFrame([(0, 1, "user", "x")] * 3, TURNS))
    assert [tuple(r)[:2] for r in again.orderBy("depth").collect()] == [(0, d) for d in range(4)]


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q) and not any(words[start : start + length - r] == words[start + r : start + length] for r in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_plain_version(letters):
    rng = random.Random(letters)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5:
                words = periods.with_period(words * 3, rng.randrange(1000))
            if rng.random() < 0.3:
                words = words[:12] * rng.randint(1, 8) + words
            texts.append(words)
        assert periods.runs(texts) == [plain_runs(words) for words in texts]


def test_long_text_with_long_period():
    rng = random.Random(1)
    root = [b"%d" % rng.randrange(10**6) for _ in range(5000)]
    words = [b"a", b"b"] + root * 4 + root[:77] + [b"c"]
    assert periods.runs([words, [b"x"] * 100_000]) == [[(2, 20_077, 5000)], [(0, 100_000, 1)]]


def test_periods_of_odd_rows(spark):
    tenth = next(d for d in range(1000) if zlib.crc32(b"%d" % d) % 10 == 0)
    rows = [(1, None, 7), (2, "", 8), (None, "a " * 9, 9), (None, "a " * 9, 9), (tenth, "one two three", 10), (tenth, None, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Period int").withColumn("extra", F.lit("e"))
    got = periods.detect(docs, batch_words=5).collect()
    assert len(got) == 6 and {r["extra"] for r in got} == {"e"}
    copies = [r for r in got if r["doc_id"] is None]
    assert copies[0] == copies[1] and copies[0]["exponent_milli"] == 9000 and copies[0]["collapsed_sha256"] == sha("a")
    assert all(r["n_runs"] == 0 and r["start"] is None and r["runs_sha256"] == sha("") for r in got if r["doc_id"] is not None)
    assert periods.detect(docs.limit(0)).count() == 0


def plain_removal(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), words in zip(rows, split):
        gone = {k for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] > 1 for k in range(i, i + window)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 2, 8, 35])
def test_removal_equals_plain_version(spark, window):
    rng = random.Random(window)
    base, rows = [f"w{i}" for i in range(6 * window)], []
    for d in range(80):
        words = [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 2 * window))]
        if rng.random() < 0.7:  # passages a little shorter, as long, or longer than a window
            a = rng.randrange(4 * window)
            words += base[a : a + window + rng.randint(-2, 6)]
        words += [f"y{rng.randrange(10**6)}" for _ in range(rng.randint(0, window))]
        if rng.random() < 0.2:
            words += ["a"] * rng.randint(1, 2 * window)
        rows.append((rng.choice([d, None]), "\t".join(words)))
    rows += [(1, None), (2, ""), rows[0], rows[0]]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_removal(rows, window)


def test_removal_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 50, 5, "x")], "doc_id long, text string, batch int, N_words string")
    got = substrings.remove_repeats(docs)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and tuple(got.first())[1:3] == (100, 100)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
