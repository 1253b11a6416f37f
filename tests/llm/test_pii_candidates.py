"""Candidates left out before decoding, tables of numbers, and secrets around other spans."""

from __future__ import annotations

import random
import time

from tessera.llm import pii


def every_candidate(text):
    """decode over all candidates, each shape tried on each segment."""
    edges = [m.start() for m in pii._TOKEN.finditer(text)] + [len(text)]
    best, back, weights = [0.0] * len(edges), [None] * len(edges), pii.trained()
    for j in range(1, len(edges)):
        best[j] = best[j - 1]
        for i in range(j):
            segment = text[edges[i] : edges[j]]
            short = j - i <= pii.MOST_TOKENS and len(segment) <= pii.MOST_CHARS
            fits = short and "\n" not in segment
            whole = not short and any(m.span() == (edges[i], edges[j]) for k in pii._UNBOUNDED for m in pii._SHAPES[k].finditer(text))
            if not (fits or whole) or segment[0].isspace() or segment[-1].isspace() or not (facts := pii._facts(text, edges[i], edges[j])):
                continue
            for kind in pii.KINDS:
                if (s := best[i] + pii._score(weights, kind, facts)) > best[j]:
                    best[j], back[j] = s, (i, kind)
    out, j = [], len(edges) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j][1], edges[back[j][0]], edges[j]))
            j = back[j][0]
    return out[::-1]


def test_no_candidate_that_wins_is_left_out():
    rng, found = random.Random(8), 0
    pieces = ["12", "7", "4111", "1111", " ", " ", ".", "-", "/", "@", " at ", " dot ", "[at]", "(.)", "+", "00", "(", ")", "abc", "Host", "\n", "token=", "AKIA0123456789AB", "é٣", "phone ", "192.168.0.1"]
    texts = [pii._synthetic(rng)[0] for _ in range(60)] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(250)]
    for text in texts:
        want = every_candidate(text)
        assert pii.decode(text, 0, len(text), pii.trained()) == want, text
        found += len(want)
    assert found > 100


def test_tables_of_numbers_take_seconds():
    rng, weights = random.Random(1), pii.trained()
    numbers = "\n".join(",".join(f"{rng.uniform(-1000, 1000):.3f}" for _ in range(8)) for _ in range(15_000))
    for text in (numbers, "1.2.3.4." * 20_000):
        began = time.process_time()
        pii.find(text, weights)
        assert time.process_time() - began < 20


def test_secrets_around_base_spans_are_found_and_redacted():
    text = "password=a@b.co;xyz secret"
    base, spans = pii.find(text, pii.trained())
    assert base == [("email", 9, 15)] and base[0] in spans and ("secret", 0, 19) in spans
    assert pii.redacted(text, spans) == "<SECRET> secret"


def test_spans_over_base_spans_are_theirs_however_many_come_before():
    text = "1.2.3.4 " * 40 + "call +49 30 1234567"
    base, spans = pii.find(text, pii.trained())
    assert len(base) == 41 and spans == base
