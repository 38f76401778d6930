"""The whole query of pseudonyms against a plain version, and forms that are found or left alone."""

from __future__ import annotations

import datetime as dt
import ipaddress
import random
import re
import time

import pytest

from ledgerloom.llm import pii, queries

KEY = b"a key for tests"


def plain(text):
    """One kind after the other over the whole text, with what is found already cut out by a list of spans."""
    if text is None:
        return None
    taken = []
    for _, _, matches, new in pii.FINDERS:
        own = [(m.start(), m.end(), new(m, KEY)) for m in matches(text) if all(m.end() <= a or m.start() >= b for a, b, _ in taken)]
        taken += [x for x in own if x[2] is not None]
    for a, b, value in sorted(taken, reverse=True):
        text = text[:a] + value + text[b:]
    return text


def luhn(digits):
    odd = [int(c) for c in digits[-1::-2]]
    even = [2 * int(c) for c in digits[-2::-2]]
    return sum(odd) + sum(x - 9 if x > 9 else x for x in even)


def iban_rest(value):
    moved = value[4:] + value[:4]
    return int("".join(c if c.isdigit() else str(ord(c) - 55) for c in moved)) % 97


def planted(rng):
    """Kind, value, and what its pseudonym has to be, by rules of this test alone."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = "4" + digits(14)
    card += next(c for c in "0123456789" if luhn(card + c) % 10 == 0)
    iban = "DE00" + digits(18)
    iban = f"DE{98 - iban_rest(iban):02d}" + iban[4:]
    ssn = f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    day = dt.date(1960, 1, 1) + dt.timedelta(rng.randrange(20_000))
    iso = lambda v: dt.date.fromisoformat(v)
    return [
        ("card", card, lambda v: re.fullmatch("[0-9]{16}", v) and luhn(v) % 10 == 0),
        ("iban", iban, lambda v: re.fullmatch("DE[0-9]{20}", v) and iban_rest(v) == 1),
        ("ssn", ssn, lambda v: re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", v) and v[:3] not in ("000", "666")),
        ("date", day.isoformat(), iso),
        ("phone", f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}", lambda v: re.fullmatch(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", v)),
        ("ip", ".".join(str(rng.randrange(1, 256)) for _ in range(4)), ipaddress.IPv4Address),
        ("email", f"user{digits(3)}@exämple{rng.randrange(9)}.com", lambda v: re.fullmatch(r"\[EMAIL-[0-9a-f]{12}\]", v)),
        ("secret", f"AKIA{digits(16)}", lambda v: v == "[SECRET]"),
    ]


def test_planted_values_are_found_and_nothing_else():
    rng, seen = random.Random(6), {}
    words = "the river and old town lay by a road to some far hills where people sang".split()
    for _ in range(300):
        parts, marks = [], []
        for kind, value, right in planted(rng):
            parts += [" ".join(rng.choices(words, k=rng.randint(1, 5))), value]
            marks.append((kind, value, right))
        new, counts = pii.pseudonymize_text(" ; ".join(parts), KEY)
        got = new.split(" ; ")
        assert got[::2] == parts[::2] and counts == dict.fromkeys(pii.KINDS, 1)
        for (kind, value, right), pseudonym in zip(marks, got[1::2]):
            assert pseudonym != value and right(pseudonym)
            assert seen.setdefault((kind, value), pseudonym) == pseudonym
    for kind in set(pii.KINDS) - {"secret"}:  # a permutation: no two values share a pseudonym
        own = [p for (k, _), p in seen.items() if k == kind]
        assert len(own) == len(set(own))


def test_very_long_texts_take_linear_time():
    began = time.perf_counter()
    for text in ("token=" * 850_000, "token=" * 850_000 + " a1", "password = secret:" * 280_000, "token='" * 700_000, "a@" * 2_500_000, "1-" * 2_500_000, "Bearer " * 700_000):
        pii.pseudonymize_text(text, KEY)
    assert time.perf_counter() - began < 60


def test_query_equals_the_plain_version_on_the_whole_table(spark, tiny):
    spark.conf.set(pii.KEY_SETTING, KEY.decode())
    try:
        got = {r["doc_id"]: r for r in queries.op10_pii(spark, tiny).collect()}
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    changed = 0
    for d, text in texts.items():
        assert got[d]["text"] == plain(text)
        changed += got[d]["text"] != text
        assert (got[d]["text"] != text) <= (sum(got[d][f"n_{k}"] for k in pii.KINDS) > 0)
    assert 0 < changed < len(texts)


@pytest.mark.parametrize(
    "text",
    [
        "on 12/05/99 at", "born 3 May 1980.", "May 12, 2024 was", "am 12. März 2021", "el 5 de mayo de 2020", "le 1er août 1999", "call 5552345678 now", "Tel: 555-0199", "phone number 555-0199",
        "Bearer abcdef0123456789XYZ", "ghp_abcdefghijklmnopqrst0123", "host 2001:db8::8a2e:370:7334 up", "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.sig",
        "ssn 123456789", "SSN: 123 45 6789", "social security number is 123456789", "0049 30 1234567", "user@exämple.com", 'token=secret="correcthorse"',
    ],
)
def test_forms_that_are_found(text):
    new, counts = pii.pseudonymize_text(text, KEY)
    assert new != text and sum(counts.values()) == 1
    assert pii.pseudonymize_text(text, KEY)[0] == new


@pytest.mark.parametrize("text", ["version 1.2.10", "at 12:30:45", "may 12 people", "a::b", "password: required", "order 5552345678", "pages 100-2000", "13/45/99", "32 May 2020", "std::vector", "v1.2.3.4", "12.5.99", "10049 30 1234567", ""])
def test_forms_that_are_left_alone(text):
    assert pii.pseudonymize_text(text, KEY)[0] == text


def test_formats_stay(spark):
    new = pii.pseudonymize_text("12/05/99|March 7, 2020|DEC 25 1999|2001:db8::1", KEY)[0].split("|")
    assert re.fullmatch(r"\d\d/\d\d/\d\d", new[0]) and dt.datetime.strptime(new[0], "%m/%d/%y")
    assert dt.datetime.strptime(new[1], "%B %d, %Y") and new[2][:3].isupper() and ipaddress.IPv6Address(new[3])
    same = [pii.pseudonymize_text(t, KEY)[0] for t in ("7 March 2020", "March 7, 2020", "2020-03-07")]
    days = {dt.datetime.strptime(x, f) for x, f in zip(same, ("%d %B %Y", "%B %d, %Y", "%Y-%m-%d"))}
    assert len(days) == 1  # one day, one pseudonym, however it is written


def test_overlaps_and_repeats(spark):
    frame = spark.createDataFrame([(1, "a@b.com 4111111111111111"), (1, "a@b.com 4111111111111111"), (2, None), (3, ""), (4, "x" * 200_000 + " 2020-01-02")], "doc_id long, text string")
    rows = pii.pseudonymize(frame, KEY).orderBy("doc_id").collect()
    assert rows[0] == rows[1] and rows[0]["n_email"] == rows[0]["n_card"] == 1
    assert rows[2]["text"] is None and rows[3]["text"] == "" and len(rows[4]["text"]) == 200_011 and rows[4]["n_date"] == 1
    overlap = pii.pseudonymize_text("token = 2020-01-02x4111111111111111", KEY)
    assert overlap[0] == "token = [SECRET]" and overlap[1]["card"] == overlap[1]["date"] == 0


def test_key_comes_from_the_session_or_is_drawn(spark):
    assert pii.key_of(spark) == pii._OWN_KEY and len(pii._OWN_KEY) == 32
    spark.conf.set(pii.KEY_SETTING, "k")
    try:
        assert pii.key_of(spark) == b"k"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
