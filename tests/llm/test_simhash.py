from __future__ import annotations

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import queries, similar, simhash
from ledgerloom.llm.components import stars


def slow_fingerprint(text: str | None) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\x0b\x0c\r":
        words = words.replace(gap, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints: dict[int, int]) -> dict[int, int]:
    """Ids to components by comparing all distinct fingerprints with each other."""
    distinct = sorted(set(prints.values()))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for d, f in prints.items():
        least[find(f)] = min(d, least.get(find(f), d))
    return {d: least[find(f)] for d, f in prints.items()}


def test_query_equals_brute_force(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    prints = {d: slow_fingerprint(t) for d, t in texts.items()}
    want = slow_components(prints)
    got = queries.op7_simhash(spark, tiny).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in texts}
    assert len(got) == len(texts)


@pytest.mark.parametrize("cap", [1, 3, 128])
def test_crowded_cells_lose_no_link(spark, cap):
    rng = random.Random(cap)
    found = {0, 1, 3, 7, (1 << 64) - 1}
    for _ in range(12):  # clouds of close fingerprints, some apart by exactly two or three bits
        centre = rng.getrandbits(64)
        found |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(40)}
    signed = [f - (f >> 63 << 64) for f in found]
    prints = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["node"]: r["root"] for r in stars(simhash.links(prints, cell_cap=cap)).collect()}
    want = slow_components(dict(zip(signed, found)))
    groups = Counter(want.values())
    for f in signed:
        if groups[want[f]] == 1:
            assert f not in got
    same = {}
    for f in signed:
        if f in got:
            assert same.setdefault(want[f], got[f]) == got[f]
    assert len(set(same.values())) == len(same)


def test_manhattan_distance_is_a_lower_bound(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a long, b long")
    own = F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b"))))
    for r in rows.select("a", "b", own.alias("d")).collect():
        segments = [abs((r["a"] >> k & 3).bit_count() - (r["b"] >> k & 3).bit_count()) for k in range(0, 64, 2)]
        assert r["d"] == sum(segments) <= (r["a"] ^ r["b"]).bit_count()


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r["node"]: r["root"] for r in stars(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, None, 1), (4, "", 2), (2, "x y", 3), (2, "x y", 3), (9, "X  y", 4), (None, "lonely words here", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = simhash.components(docs).collect()
    assert len(got) == 6
    of = {(r["doc_id"], r["component_id"]) for r in got}
    assert of == {(None, 4), (4, 4), (2, 2), (9, 2), (None, None)}
    assert simhash.components(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e", 1, "p"), (3, "A b c d e", 2, "q"), (3, "A b c d e", 2, "q"), (8, None, 3, None), (9, "", 4, "r"), (None, "z z z", 5, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies int, w_id string")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["copies"] for r in kept.collect())) == [2, 3, 5]
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def slow_similarity(a: str, b: str) -> float:
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def near_copies(n: int) -> list[tuple[int, str]]:
    """Pairs of texts of 40 to 200 words, one or more words apart, and similar from 0.8 on."""
    rng, out = random.Random(5), []
    while len(out) < 2 * n:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 200))]
        copy = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 45))):
            copy[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        if slow_similarity(" ".join(words), " ".join(copy)) >= 0.8:
            out += [(len(out), " ".join(words)), (len(out) + 1, " ".join(copy))]
    return out


def test_stage_finds_near_copies(spark):
    rows = near_copies(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0}
    # The rule of op7, two bits of words in threes, misses most of them.
    assert simhash.deduplicate(docs).count() > 1.5 * len(kept)


@pytest.mark.parametrize("crowd", [2, 64])
def test_similar_texts_equal_brute_force(spark, crowd):
    rng = random.Random(crowd)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # one large group, and texts that share only a part of it
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 9])):
            words[rng.randrange(len(words))] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + d, t) for d, t in near_copies(10)] + [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a c")]
    texts = dict(rows)
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and slow_similarity((texts[a] or "").lower(), (texts[b] or "").lower()) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.components(docs, crowd=crowd).collect()}
    assert got == {d: find(d) for d in texts}


def _pairs_of_texts(n):
    """Texts 2k and 2k + 1 are alike, others are not."""
    rng, texts = random.Random(8), []
    for _ in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    return texts


def test_near_copies_that_meet_in_crowded_cells_only(spark):
    """All texts share their cells, and no finer one: each pair that is alike is linked, although leads reach few."""
    texts = _pairs_of_texts(40)
    rows = [(k + 1, k + 1, 10_000 * k, [7] * similar.BANDS + [100 * k + i for i in range(similar.FINE)]) for k in range(len(texts))]
    distinct = spark.createDataFrame(rows, "fp long, h long, sim long, bands array<long>")
    docs = spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "h long, text string")
    got = {tuple(sorted(r)) for r in similar.links(distinct, docs, crowd=8).collect()}
    assert got == {(k, k + 1) for k in range(1, len(texts), 2)}


def test_near_copies_come_through_the_grid_join(spark):
    """Fingerprints within two bits are candidates whatever the bands say; the whole sets decide."""
    texts = _pairs_of_texts(3)
    sims = [0b1111 << 32, 0b0011 << 32, -1, -1, 0, 7 << 50]  # within 2, 0 and 3 bits of the partner; the fifth of the second as well
    rows = [(k + 1, k + 1, sims[k], [100 * k + i for i in range(similar.BANDS + similar.FINE)]) for k in range(len(texts))]
    distinct = spark.createDataFrame(rows, "fp long, h long, sim long, bands array<long>")
    docs = spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "h long, text string")
    assert {tuple(sorted(r)) for r in similar.links(distinct, docs).collect()} == {(1, 2), (3, 4)}
