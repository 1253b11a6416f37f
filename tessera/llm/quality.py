"""Quality rules: fixed counts of a text, and a linear-chain conditional random field over its lines.

The field marks each line as content or boilerplate from the line's own shape and its neighbours' labels (Viterbi decoding);
a text is kept if its content lines hold enough of its words. It is trained here on made-up line sequences."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import SPACES, long_array, map_columns, table, texts

SYMBOLS = "#*$%&|<>"
#: A text needs this many words, and this share (percent) of them at most may stand in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of the words that content lines must hold.
LEAST_CONTENT = 0.5

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile("[#*$%&|<>]")
_LEGAL = re.compile(r"rights reserved|copyright|©|licen[sc]ed? |cookie|privacy|terms of|subscribe|sign (?:in|up)|log ?in|click here|read more|https?://", re.I)


# ---------------------------------------------------------------- counts


def counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of the whole text."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    repeated = 0
    windows = Counter(zip(words, words[1:], words[2:]))
    if len(windows) < len(words) - 2:
        covered = 0  # words before this index are counted
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), chars, symbols, dup, repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


# ---------------------------------------------------------------- the field

_LENGTHS = (1, 3, 6, 12, 25)


def line_facts(line: str, words: list[str], seen: bool) -> list[str]:
    """Features of one line that has words."""
    n = len(words)
    out = ["any", f"words:{sum(n > x for x in _LENGTHS)}"]
    symbols = len(_SYMBOL.findall(line))
    out.append("symbols:" + ("0" if not symbols else "few" if 10 * symbols < n else "some" if 4 * symbols < n else "many"))
    caps = sum(map(str.isupper, words))
    out.append("caps:" + ("few" if 5 * caps < n else "some" if 2 * caps < n else "most"))
    marks = line.count("!")
    out.append("marks:" + ("few" if 6 * marks <= n else "many"))
    if n > 3:
        different = len(set(words))
        out.append("varied" if 3 * different > 2 * n else "some_varied" if 3 * different > n else "same")
    end = words[-1][-1]
    out.append("end:" + ("stop" if end in ".!?…»\"'”)" else "comma" if end in ",;:" else "open"))
    digits = sum(any(map(str.isdigit, w)) for w in words)
    if 3 * digits > n:
        out.append("numbers")
    if line[:1].isupper():
        out.append("capital")
    if seen:
        out.append("seen")
    if 40 * len(_LEGAL.findall(line)) > n:  # one is enough in a line under 40 words, a long line needs as many by length
        out.append("legal")
    return out


#: Weights by (label, feature) and (label before, label); label 1 is content.
Weights = dict[tuple, float]


def _scores(weights: Weights, facts: list[str]) -> tuple[float, float]:
    return sum(weights.get((0, f), 0.0) for f in facts), sum(weights.get((1, f), 0.0) for f in facts)


def viterbi(rows: list[tuple[float, float]], weights: Weights) -> list[int]:
    """The most probable labels of a sequence of (score as boilerplate, score as content)."""
    t = [[weights.get((a, b), 0.0) for b in (0, 1)] for a in (0, 1)]
    back, best = [], rows[0]
    for row in rows[1:]:
        from0 = 0 if best[0] + t[0][0] >= best[1] + t[1][0] else 1
        from1 = 0 if best[0] + t[0][1] > best[1] + t[1][1] else 1
        back.append((from0, from1))
        best = (best[from0] + t[from0][0] + row[0], best[from1] + t[from1][1] + row[1])
    label = int(best[1] >= best[0])
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _step(facts: list[list[str]], gold: list[int], weights: Weights, rate: float) -> None:
    """One gradient step on a sequence's log-likelihood."""
    rows, t = [_scores(weights, f) for f in facts], [[weights.get((a, b), 0.0) for b in (0, 1)] for a in (0, 1)]
    ahead, behind = [rows[0]], [(0.0, 0.0)]
    for row in rows[1:]:
        p = ahead[-1]
        ahead.append(tuple(row[b] + _log_add(p[0] + t[0][b], p[1] + t[1][b]) for b in (0, 1)))
    for row in reversed(rows[1:]):
        p = behind[-1]
        behind.append(tuple(_log_add(t[a][0] + row[0] + p[0], t[a][1] + row[1] + p[1]) for a in (0, 1)))
    behind.reverse()
    whole = _log_add(*ahead[-1])
    for k, f in enumerate(facts):
        for y in (0, 1):
            g = rate * ((gold[k] == y) - math.exp(ahead[k][y] + behind[k][y] - whole))
            for x in f:
                weights[y, x] = weights.get((y, x), 0.0) + g
        if k:
            for a in (0, 1):
                for b in (0, 1):
                    g = (gold[k - 1] == a and gold[k] == b) - math.exp(ahead[k - 1][a] + t[a][b] + rows[k][b] + behind[k][b] - whole)
                    weights[a, b] = weights.get((a, b), 0.0) + rate * g


def _made_up(rng: random.Random) -> tuple[list[str], list[int]]:
    """Lines and labels: prose, with menus, tables, shouting, decorated words, stuttering, legal lines and copies between."""
    common = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.choice((1, 2, 3)))) for _ in range(8)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.choice((2, 3, 4, 5, 6, 7, 9))))
    some = lambda a, b: [word() for _ in range(rng.randint(a, b))]

    def prose() -> str:
        out = []
        for _ in range(rng.choice((1, 1, 2, 3, 6, 20))):
            ws = some(2, 18)
            out.append(" ".join(w + "," * (rng.random() < 0.08) for w in ws).capitalize() + rng.choice(".....?!"))
        if rng.random() < 0.1:
            out.insert(0, rng.choice(["a@b.com", "+1 (555) 555-0100", "10.0.0.1", "4111111111111111"]))
        return " ".join(out)[: None if rng.random() < 0.8 else -1]

    def junk() -> str:
        kind, ws = rng.randrange(8), some(3, rng.choice((8, 30, 150)))
        ws = prose().split() if rng.random() < 0.6 else ws
        if kind == 0:
            return " ".join(w + rng.choice("#*$%&") * rng.randint(1, 3) for w in ws)
        if kind == 1:
            return " ".join(w.upper() + "!" * rng.randint(0, 2) for w in ws)
        if kind == 2:
            return " | ".join(ws)
        if kind == 3:
            w = word()
            return " ".join([w] * rng.randint(5, 40) + [word()] * rng.choice((0, 10, 30)))
        if kind == 4:
            return " ".join(some(1, 3)).capitalize()
        if kind == 5:
            return rng.choice(["All rights reserved.", "Copyright 2020 " + word(), "Read more", "Licensed under the " + word() + " License.", "Click here to sign in", "We use cookies. Privacy policy"])
        if kind == 6:
            return " ".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(2, 12)))
        return " ".join(a for w in ws for a in (w, rng.choice("|<>*#")))

    lines, labels, state = [], [], rng.randint(0, 1)
    for _ in range(rng.randint(1, 14)):
        state = state if rng.random() < 0.85 else 1 - state
        line = prose() if state else rng.choice(lines) if lines and rng.random() < 0.1 else junk()
        lines.append(line)
        labels.append(state)
    return lines, labels


def sequence_facts(lines: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and numbers of words of the lines that have words."""
    seen: set[str] = set()
    facts, sizes = [], []
    for line in lines:
        if words := _WORDS.findall(line):
            facts.append(line_facts(line, words, line in seen))
            sizes.append(len(words))
            seen.add(line)
    return facts, sizes


@lru_cache(maxsize=4)
def trained(sequences: int = 500, rounds: int = 6, seed: int = 5) -> Weights:
    rng, weights = random.Random(seed), {}
    data = [(sequence_facts(lines)[0], labels) for lines, labels in (_made_up(rng) for _ in range(sequences))]
    for r in range(rounds):
        for facts, labels in data:
            _step(facts, labels, weights, 0.15 / (1 + r))
    return weights


def content_share(text: str, weights: Weights) -> float:
    """Share of words in lines that the field marks as content; 0 for a text without words."""
    facts, sizes = sequence_facts(text.split("\n"))
    if not facts:
        return 0.0
    labels = viterbi([_scores(weights, f) for f in facts], weights)
    return sum(n for n, y in zip(sizes, labels, strict=True) if y) / sum(sizes)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assessed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_content: float = LEAST_CONTENT) -> DataFrame:
    """(id, the counts, base_failed, content_share, kept) of each row of docs. A null text has no words and is not kept; ids may be
    null or repeat; rows stay apart."""
    weights = trained()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(*counts(x), content_share(x, weights)) for x in texts(batch.column(1))]
        failed = [base_failed(r[0], r[4]) for r in rows]
        kept = [not bad and r[5] >= least_content for bad, r in zip(failed, rows, strict=True)]
        columns = [long_array([r[k] for r in rows]) for k in range(5)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed), pa.array([r[5] for r in rows], pa.float64()), pa.array(kept)], names=["id", *_COUNTS, "base_failed", "content_share", "kept"])

    held = docs.select(id_col, text_col)
    return map_columns(held, run, f"id {held.dtypes[0][1]}, {', '.join(f'{c} long' for c in _COUNTS)}, base_failed boolean, content_share double, kept boolean")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents the counts, base_failed and the verdict kept. A null text has no words, has failed and isn't kept;
    repeated and null ids have a row each; an empty table gives none; other columns are not read."""
    return assessed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
