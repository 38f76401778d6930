"""Leaves with many families of lines."""

from __future__ import annotations

import random
from collections import Counter

from ledgerloom.llm import linededup


def test_every_family_of_a_leaf_gets_its_template(spark):
    rng, rows = random.Random(1), []
    for family in range(10):
        words = [f"f{'abcdefghij'[family]}{'klmnopqrst'[p]}" for p in range(9)]
        for copy in range(3):  # each differs from the others of its family in one place or two
            own = list(words)
            own[rng.randrange(9)] = f"own{'abc'[copy]}{'abcdefghij'[family]}"
            rows.append((3 * family + copy, "the same start " + " ".join(own)))
    texts = dict(rows)
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:  # without a limit of rounds: all pairs
        for b in texts:
            x, y = texts[a].split(), texts[b].split()
            if a < b and sum(s == t for s, t in zip(x, y)) >= 0.8 * len(x):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_recurring(docs).collect()}
    assert got == {d: int(find(d) != d) for d in texts}
    assert sum(got.values()) == 20


def test_three_families_of_fields_in_one_leaf(spark):
    """Lines of three templates that begin alike; each template has a field that varies, and four documents."""
    words = ["went to the market with all of his", "stood by the river and looked at some", "called the office about a bill for nine"]
    names = ["ann", "bob", "cy", "dan"]
    rows = [(4 * f + k, f"the same start {w} {name}") for f, w in enumerate(words) for k, name in enumerate(names)]
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: int(d % 4 != 0) for d, _ in rows}


def test_a_crowded_cell_is_split_exactly(spark):
    """More kinds than CROWD agree in a block of tokens; only neighbours in a chain are alike."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for pair in range(60):
        tail = [word() for _ in range(12)]
        rows += [(2 * pair, " ".join(["one", "two", "three", "x", "y", "z", *tail])), (2 * pair + 1, " ".join(["one", "two", "three", "x", "y", "z", *tail[:-1], word()]))]
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d % 2 for d, _ in rows}


def test_columns_with_the_names_of_helpers_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "k", 2), (2, "a b c d e", "l", 3), (3, None, None, None)], "doc_id long, text string, __key string, `dropped` int")
    got = {r["doc_id"]: (r["text"], r["__key"], r["dropped"]) for r in linededup.drop_recurring(docs).collect()}
    assert got == {1: ("a b c d e", "k", 2), 2: ("", "l", 3), 3: (None, None, None)}


def test_very_many_families_in_one_leaf(spark, monkeypatch):
    """Rounds do not grow with the families of a leaf, and each family is found."""
    rng, rows, writes = random.Random(3), [], []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    for family in range(300):
        tail = [word() for _ in range(8)]
        for copy in range(2):
            own = list(tail)
            own[rng.randrange(8)] = word()
            rows.append((2 * family + copy, " ".join(["alike", "from", "here", *own])))
    plain = linededup.materialize
    monkeypatch.setattr(linededup, "materialize", lambda df, name: writes.append(name) or plain(df, name))
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alike = lambda a, b: sum(x == y for x, y in zip(a.split(), b.split())) >= 0.8 * 11
    assert got == {d: int(d % 2 and alike(rows[d - 1][1], t)) for d, t in rows}
    assert sum(got.values()) > 200 and len(writes) < 35


def test_crowded_cells_lose_few_links(spark):
    """Families of very many kinds of lines in one leaf, of which each differs from the family's line in one place: recall over 0.9."""
    rng, rows, d = random.Random(4), [], 0
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    for size in (200, 2000):
        tail = [word() for _ in range(12)]
        for _ in range(size):
            own = list(tail)
            own[rng.randrange(12)] = word()
            rows.append((d, " ".join(["one", "way", "to", *own])))
            d += 1
    left = [linededup._signed(t.encode()) for _, t in rows]
    lines = spark.createDataFrame([(1, h, t.split()) for h, (_, t) in zip(left, rows)], "leaf long, line long, tokens array<string>")
    linked = {r["node"] for r in linededup.stars(linededup._alike(lines, 0.8)).collect()}
    assert len(linked) >= 0.9 * len(rows)


def test_lines_that_meet_in_crowded_cells_only(spark):
    """Pairs that differ in three places and share no block but those that all lines share: none is lost."""
    rng, lines = random.Random(6), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    for _ in range(150):
        tail = [word() for _ in range(6)]
        other = [word() if k in (0, 1, 3) else t for k, t in enumerate(tail)]
        lines += [["one", "way", "to", "b1", "b2", "b3", "c1", "c2", "c3", *t] for t in (tail, other)]
    signed = [linededup._signed(" ".join(t).encode()) for t in lines]
    rows = spark.createDataFrame([(1, h, t) for h, t in zip(signed, lines)], "leaf long, line long, tokens array<string>")
    got = {tuple(sorted(r)) for r in linededup._alike(rows, 0.8).collect()}
    assert got == {tuple(sorted(signed[k : k + 2])) for k in range(0, 300, 2)}


def test_only_lines_that_can_go_are_looked_at_again(spark, monkeypatch):
    """What is read again after the kinds are counted follows the lines that recur, not all lines."""
    rng, seen = random.Random(7), {}
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = [(d, "\n".join([" ".join(word() for _ in range(9)) for _ in range(20)] + [f"the line that {d % 2} and others have in common"])) for d in range(30)]
    plain = linededup.materialize

    def counted(df, name):
        seen[name] = (out := plain(df, name)).count()
        return out

    monkeypatch.setattr(linededup, "materialize", counted)
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: int(d > 0) for d, _ in rows}
    assert seen["lines"] == 21 * 30 and seen["placed"] == 30


def test_long_lines_in_a_crowded_cell(spark):
    """Lines of 400 tokens that share their first half, or nearly: those that are alike are linked, and no others."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    same, lines = [word() for _ in range(200)], []
    for _ in range(40):
        own = [word() for _ in range(200)]
        lines += [same + own, [t if k % 6 else word() for k, t in enumerate(same)] + own[:-10] + [word() for _ in range(10)]]
    lines += [same + [word() for _ in range(200)] for _ in range(70)]
    signed = [linededup._signed(" ".join(t).encode()) for t in lines]
    rows = spark.createDataFrame([(1, h, t) for h, t in zip(signed, lines)], "leaf long, line long, tokens array<string>")
    got = {tuple(sorted(r)) for r in linededup._alike(rows, 0.8).collect()}
    assert got == {tuple(sorted(signed[k : k + 2])) for k in range(0, 80, 2)}


def test_votes_of_parts_add_up(spark, monkeypatch):
    """Leaves of one part and of several get the token of most documents in each place, however a leaf is cut and rows are repeated."""
    rng, rows = random.Random(9), []
    for leaf in range(40):
        for k in range(rng.randrange(1, 30)):
            rows.append((leaf, 100 * leaf + k, rng.randrange(1, 4), [rng.choice(["é", "z", "\U0001f600", "\uffee", "ab", "b"]) for _ in range(8 + leaf % 3)]))
    want = {}
    for leaf in range(40):
        places = [Counter() for _ in range(8 + leaf % 3)]
        for _, _, n, tokens in (r for r in rows if r[0] == leaf):
            for place, token in zip(places, tokens):
                place[token] += n
        want[leaf] = [max(p, key=lambda t: (p[t], t.encode())) for p in places]
    for parts in (1, 3):
        cut = [(leaf, line, n, 1 + (parts - 1) * (leaf % 2), t) for leaf, line, n, t in rows + rows[:200]]
        frame = spark.createDataFrame(cut, "leaf long, line long, n_docs long, parts long, tokens array<string>")
        assert {r["leaf"]: r["template"] for r in linededup._templates(frame).collect()} == want
