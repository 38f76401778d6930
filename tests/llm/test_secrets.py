"""Secrets behind a key: their whole length, and quoted ones without a digit."""

from __future__ import annotations

import pytest

from ledgerloom.llm import pii

CASES = [
    ("token = " + "a1" * 2000 + " end", "token = [SECRET] end"),
    ('password = "correcthorsebattery" end', 'password = "[SECRET]" end'),
    ("'secret': 'correcthorse', x", "'secret': '[SECRET]', x"),
    ('password = "password"', 'password = "[SECRET]"'),
    ('token = "abc123def" end', 'token = "[SECRET]" end'),
    ("token: something else", "token: something else"),
    ('token = "short"', 'token = "short"'),
]


@pytest.mark.parametrize("text, want", CASES)
def test_secret_values(text, want):
    assert pii.pseudonymize_text(text)[0] == want
