"""Entities of many letter and digit changes, and those without a digit nearby."""

from __future__ import annotations

import pytest

from tessera.llm import pii

KEY = "a1b2c3d4e5f60718293a4b5c6d7e8f90"


@pytest.mark.parametrize("size", [40, 64, 128])
def test_hex_keys_are_found_whole(size):
    key = (KEY * 4)[:size]
    text = f'so token = "{key}" it is'
    assert ("secret", 3, 12 + size) in [(k, s, e) for k, s, e in pii.find(text, pii.trained())[1] if e == 12 + size]
    assert key[:6] not in pii.redacted(text, pii.find(text, pii.trained())[1])


@pytest.mark.parametrize("text,want", [
    ("mail name (at) host.com now", [("email", 5, 23)]),
    ("mail name [at] host.com now", [("email", 5, 23)]),
    ("password=abcdefgh ok", [("secret", 0, 17)]),
    ("use ghp_abcdefghijklmnopqrstuvwx now", [("secret", 4, 32)]),
])
def test_entities_far_from_digits(text, want):
    assert pii.find("plain words " * 20 + text, pii.trained())[1] == [(k, s + 240, e + 240) for k, s, e in want]


def test_long_runs_take_linear_time():
    for text in ("a1" * 100_000, "a" * 200_000, ("1" + "a" * 200) * 1000, "token=" * 30_000):
        pii.find(text, pii.trained())
