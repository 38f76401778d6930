"""The whole pipeline over a small table, against a plain version of each stage's rules that shares no code with it."""

from __future__ import annotations

import hashlib
import hmac
import random
import re
from collections import defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import pii
from ledgerloom.llm.queries import WORD_BPE
from ledgerloom.llm.wordpieces import public_path

KEY = "a key of the test"
WORDS = {
    "en": "the house river under stone bridge morning people walked slowly through old streets while birds were singing above green fields and quiet water".split(),
    "de": "das haus fluss unter steinerne brücke morgen menschen gingen langsam durch alte straßen während vögel über grünen feldern sangen und ruhiges wasser".split(),
}


def table():
    """Prose in two languages with repeated lines, near copies, addresses, and rows that are no language."""
    rng, rows = random.Random(11), []
    line = lambda lang, n: " ".join(rng.choices(WORDS[lang], k=n))
    footer = {"en": "please visit our page number {} for further news", "de": "bitte besuchen sie unsere seite nummer {} für neues"}
    for d in range(60):
        lang = "en" if d % 2 else "de"
        text = [line(lang, rng.randint(60, 100)) for _ in range(rng.randint(2, 4))]
        if d % 5 == 0:
            text.append(footer[lang].format(d))  # differs in a number only
        if d % 7 == 0:
            text.insert(1, f"write to person{d % 3}@example.org " + line(lang, 12))
        rows.append((100 + d, "\n".join(text), lang))
    for d in (103, 110, 121):  # a copy with words put in, so that no line is the same and few sequences of words are lost
        words = dict((r[0], r[1]) for r in rows)[d].split("\n")
        rows.append((300 + d, "\n".join(" ".join(["also", *w.split()]) for w in words), "en" if d % 2 else "de"))
    rows += [(500, None, "en"), (501, "", "de"), (502, "12 34 56 --", "en"), (101, rows[1][1], "en")]
    return rows


def plain(rows):
    kept = [[d, t] for d, t, _ in rows if t and re.search(r"[^\W\d_]", t)]
    # Lines of four tokens and more that agree but for tokens with digits: the first stays. Lines here are else far from each other.
    order = sorted({(d, t) for d, t in kept})
    first, where = {}, defaultdict(set)
    key = lambda x: tuple("#" if re.search(r"\d", w) else w for w in x.split())
    for d, t in order:
        for k, x in enumerate(t.split("\n")):
            if len(x.split()) >= 4:
                first.setdefault(key(x), (d, t, k))
                where[key(x)].add((d, t))
    out = []
    for d, t in kept:
        left = [x for k, x in enumerate(t.split("\n")) if len(x.split()) < 4 or len(where[key(x)]) < 2 or first[key(x)] == (d, t, k)]
        if len(left) == len(t.split("\n")) or "".join(left).strip():
            out.append((d, "\n".join(left)))
    # Four fifths of the sequences of five words.
    pieces = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    group = list(range(len(out)))
    for i, (_, a) in enumerate(out):
        for j, (_, b) in enumerate(out[:i]):
            x, y = pieces(a), pieces(b)
            if len(x & y) >= 0.8 * len(x | y):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    chosen = {}
    for g, row in zip(group, out):
        chosen[g] = min(chosen.get(g, row), row)
    tag = lambda m: f"[EMAIL-{hmac.new(KEY.encode(), m[0].encode(), hashlib.sha256).hexdigest()[:12]}]"
    return {d: re.sub(r"\S+@example\.org", tag, t) for d, t in chosen.values()}


def test_pipeline_equals_the_plain_version(spark, tmp_path):
    rows = table()
    spark.createDataFrame([(d, t, g, "s", len(t or "")) for d, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set(pii.KEY_SETTING, KEY)
    try:
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    want = plain(rows)
    assert len(want) < len(rows) - 6 and any("EMAIL" in t for t in want.values())
    own = Tokenizer.from_file(public_path(WORD_BPE))
    parts = defaultdict(dict)
    for r in got:
        parts[r["doc_id"]][r["start"]] = bytes(r["ids"])
    assert parts.keys() == want.keys()
    for d, t in want.items():
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        assert b"".join(x for _, x in sorted(parts[d].items())) == b"".join(i.to_bytes(4, "little") for i in ids), d
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():  # gapless from 0, within the window
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
