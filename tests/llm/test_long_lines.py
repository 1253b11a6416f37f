from __future__ import annotations

from tessera.llm import quality


def facts(line):
    return quality.line_facts(line, line.split(), False)


def test_numbers_count_in_lines_of_any_length():
    for n in (399, 400, 500, 20_000):
        assert "numbers" in facts(" ".join(str(7919 * k) for k in range(n)))


def test_legal_counts_in_long_lines():
    assert "legal" in facts("All rights reserved. " * 100) and "legal" not in facts("some words " * 100 + "copyright")


def test_long_numeric_line_is_judged_as_shorter_ones():
    numbers, weights = [str(7919 * k) for k in range(1, 501)], quality.trained()
    assert quality.content_share(" ".join(numbers), weights) == quality.content_share(" ".join(numbers[:399]), weights) == 0.0
