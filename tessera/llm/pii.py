"""Personal data: patterns, and a semi-Markov conditional random field for what the patterns miss.

The field scores whole candidate segments (their digits, shape, separators, checksum and the words before them), and dynamic
programming over segments of bounded length (assigned secrets and keys: of any length) chooses boundaries and kinds together.
Every candidate, which is what has a shape or seven digits, holds a digit, '@', a bracketed 'at' or dot, a spelled-out 'dot', or is
an assigned secret or a key; so the field runs on their neighbourhoods, as wide as a candidate may be, and finds what it would
find in the whole text.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import count, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table, texts

KINDS = ("email", "ip", "card", "phone", "secret")
Span = tuple[str, int, int]

# ---------------------------------------------------------------- patterns

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NON_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of local@domain. A match begins at the start of the run of local characters before
    an '@' (or where the last match ended), so each run is looked at once and the time is linear."""
    out, at, ended = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > ended and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            ended = m.end()
        else:
            ended = max(ended, start)
        at = text.find("@", max(ended, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by kind and then start. Matches that fail their check are dropped and not tried again."""
    out = _emails(text)
    if not re.search("[0-9]", text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 64 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- the field

#: Bounds of an entity, in tokens and code points; whole matches of _UNBOUNDED shapes are candidates beyond them.
MOST_TOKENS, MOST_CHARS = 24, 96

_TRIGGER = re.compile(r"[\d@]+|\bdot\b|[\(\[]\s?(?:at|dot|\.)\s?[\)\]]", re.I)
_TOKEN = re.compile(r"[^\W_]+|[^\S\n]+|\n|[^\w\s]|_")
_RUN = re.compile(r"[^\W_]++|[^\S\n]++|")
_UNBOUNDED = ("assigned", "key_like")
_GOES_ON = re.compile(r"[^\s\"']*")
_AT_SIGN = re.compile("@|at", re.I)
_AT = r"(?:@|\s?[\(\[]\s?at\s?[\)\]]\s?)"
_SAID_DOT = r"(?:\s?[\(\[]\s?(?:dot|\.)\s?[\)\]]\s?|\sdot\s)"
_DOT = rf"(?:\.|{_SAID_DOT})"
_NAME = r"[A-Za-z0-9-]+"
_SHAPES = {
    # An 'at' without a mark needs its dots spelled out too: 'look at example.com' is no address.
    "email_like": re.compile(rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*(?:{_AT}{_NAME}(?:{_DOT}{_NAME})*{_DOT}|\sat\s{_NAME}(?:{_SAID_DOT}{_NAME})*{_SAID_DOT})[A-Za-z]{{2,8}}", re.I),
    "ip_like": re.compile(rf"\d{{1,3}}(?:{_DOT}\d{{1,3}}){{3}}", re.I),
    "card_like": re.compile(r"\d{4}(?:([ ./_-]{1,3})\d{4})(?:\1\d{4}){1,2}(?:\1\d{1,3})?|\d{13,19}|\d{4}[ .-]\d{6}[ .-]\d{5}"),
    "phone_like": re.compile(r"(?:(?:\+|00)\d{1,3}[ ./-]?)?(?:\(\d{2,4}\)[ ./-]?|\d{2,4}[ ./-])\d{3,4}[ ./-]\d{4}"),
    "phone_intl": re.compile(r"(?:\+|00)\d{1,3}(?:[ ./()-]{1,2}\d{2,4}){2,5}\)?"),
    "assigned": re.compile(r"(?:password|passwd|pwd|secret|token|api_?key|access_?key)\s?[=:]\s?[\"']?[^\s\"']{6,}", re.I),
    "key_like": re.compile(r"(?:AKIA|ASIA|ghp_|sk_live_|xox[bp]-)[A-Za-z0-9_-]{12,}"),
    "date_like": re.compile(r"\d{1,4}[-./]\d{1,2}[-./]\d{1,4}"),
}
_BEFORE = {
    "said_phone": re.compile(r"phone|mobile|\btel\b|\bcall\b|\bfax\b|telefon|móvil", re.I),
    "said_card": re.compile(r"\bcard|visa|mastercard|karte|tarjeta|\bcarte\b", re.I),
    "said_ip": re.compile(r"\bip\b|host|server|address", re.I),
    "said_mail": re.compile(r"e-?mail|contact|write|correo", re.I),
}


def _facts(text: str, start: int, end: int, shapes: Iterable[str] = tuple(_SHAPES), shapeless: bool = True) -> list[str] | None:
    """The features of a candidate segment, or None if it can't be an entity: without one of the shapes it needs seven digits, and
    shapeless ones to be asked for."""
    found = [k for k in shapes if _SHAPES[k].fullmatch(text, start, end)]
    if not found and not shapeless:
        return None
    span = text[start:end]
    digits = sum(map(str.isdecimal, span))
    if not found and digits < 7:
        return None
    out = ["any", *found]
    out.append("digits:" + ("0" if not digits else "1-6" if digits < 7 else "7-8" if digits < 9 else "9-12" if digits < 13 else "13-19" if digits < 20 else "20+"))
    if "card_like" in found and luhn(re.sub(r"\D", "", span)):
        out.append("luhn")
    if "ip_like" in found:
        out.append("octets" if all(int(x) <= 255 for x in re.findall(r"\d+", span)) else "no_octets")
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        out.append("inside_word")
    elif (start and not text[start - 1].isspace() and text[start - 1] not in "(:\"'<[") or (end < len(text) and not text[end].isspace() and text[end] not in ".,;:)\"'>]!?"):
        out.append("joined")
    if text[end : end + 1] == "." and text[end + 1 : end + 2].isalnum():
        out.append("goes_on")
    if not found:
        out.append("no_shape")
    before = text[max(0, start - 24) : start]
    out += [k for k, p in _BEFORE.items() if p.search(before)]
    return out


def _candidates(text: str, lo: int, hi: int, shapeless: bool = True) -> tuple[list[int], dict[int, list[tuple[int, list[str]]]]]:
    """Token edges of text[lo:hi], and by the index of its last edge each candidate's first edge and features. The shapes that a
    segment may have are looked for once at each first edge; where there are none, only shapeless candidates begin."""
    edges = [lo + m.start() for m in _TOKEN.finditer(text[lo:hi])] + [hi]
    blank = [text[e].isspace() if e < len(text) else True for e in edges]
    ats, next_at = [m.start() for m in _AT_SIGN.finditer(text, lo, hi)], 0
    out: dict[int, list[tuple[int, list[str]]]] = {}
    for i in range(len(edges) - 1):
        if blank[i]:
            continue
        start, limit = edges[i], min(hi, edges[i] + MOST_CHARS)
        while next_at < len(ats) and ats[next_at] < start:
            next_at += 1
        no_at = next_at == len(ats) or ats[next_at] >= limit
        shapes = [k for k, shape in _SHAPES.items() if not (no_at and k == "email_like") and shape.match(text, start, limit)]
        if not shapes and not shapeless:
            continue
        for j in range(i + 1, min(i + MOST_TOKENS, len(edges) - 1) + 1):
            if edges[j] > limit or text[edges[j] - 1] == "\n":
                break
            if not blank[j - 1] and (facts := _facts(text, start, edges[j], shapes, shapeless)):
                out.setdefault(j, []).append((i, facts))
    at = {e: k for k, e in enumerate(edges)}
    for shape in _UNBOUNDED:
        for m in _SHAPES[shape].finditer(text, lo, hi):
            i, j = at.get(m.start()), at.get(m.end())
            if i is not None and j is not None and (j - i > MOST_TOKENS or edges[j] - edges[i] > MOST_CHARS) and (facts := _facts(text, edges[i], edges[j])):
                out.setdefault(j, []).append((i, facts))
    return edges, out


Weights = dict[tuple[str, str], float]


def _score(weights: Weights, kind: str, facts: list[str]) -> float:
    return sum(weights.get((kind, f), 0.0) for f in facts)


def _shapeless_may_win(weights: Weights) -> bool:
    """Whether a segment without a shape can score over 0, whatever else is true of it."""
    always, never = ("any", "no_shape"), (*_SHAPES, "luhn", "octets", "no_octets")
    return any(sum(w for (k, f), w in weights.items() if k == kind and (f in always or (w > 0 and f not in never))) > 0 for kind in KINDS)


def decode(text: str, lo: int, hi: int, weights: Weights) -> list[Span]:
    """The best segmentation of text[lo:hi]: tokens outside of entities score 0, an entity what its features weigh. Candidates that
    can't score over 0, which no best segmentation has, aren't made."""
    edges, ending = _candidates(text, lo, hi, _shapeless_may_win(weights))
    best, back = [0.0] * len(edges), [None] * len(edges)
    for j in range(1, len(edges)):
        best[j] = best[j - 1]
        for i, facts in ending.get(j, ()):
            for kind in KINDS:
                if (s := best[i] + _score(weights, kind, facts)) > best[j]:
                    best[j], back[j] = s, (i, kind)
    out, j = [], len(edges) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((kind, edges[i], edges[j]))
            j = i
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _step(n: int, ending: dict, gold: set, weights: Weights, rate: float) -> None:
    """One gradient step on a sentence's log-likelihood: forward and backward sums over all segmentations."""
    ahead, behind = [0.0] * n, [0.0] * n
    spans = [(i, j, kind, facts, _score(weights, kind, facts)) for j, xs in ending.items() for i, facts in xs for kind in KINDS]
    by_end: dict[int, list] = {}
    by_start: dict[int, list] = {}
    for s in spans:
        by_end.setdefault(s[1], []).append(s)
        by_start.setdefault(s[0], []).append(s)
    for j in range(1, n):
        ahead[j] = ahead[j - 1]
        for i, _, _, _, s in by_end.get(j, ()):
            ahead[j] = _log_add(ahead[j], ahead[i] + s)
    for i in range(n - 2, -1, -1):
        behind[i] = behind[i + 1]
        for _, j, _, _, s in by_start.get(i, ()):
            behind[i] = _log_add(behind[i], behind[j] + s)
    for i, j, kind, facts, s in spans:
        gradient = ((i, j, kind) in gold) - math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[-1]))
        if abs(gradient) > 1e-4:
            for f in facts:
                weights[kind, f] = weights.get((kind, f), 0.0) + rate * gradient


def _synthetic(rng: random.Random) -> tuple[str, list[Span]]:
    """A made-up sentence with entities and look-alikes; the field learns from these alone."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(sep: str) -> str:
        body = rng.choice("345") + num(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def entity() -> tuple[str, str]:
        kind, hard = rng.choice(KINDS), rng.random() < 0.6
        if kind == "email":
            at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), ("(at)", ".")]) if hard else ("@", ".")
            return kind, word() + rng.choice(["", dot + word(), num(2)]) + at + word() + dot + rng.choice(["com", "org", "net", "example.com" if dot == "." else "com"])
        if kind == "ip":
            return kind, (rng.choice(["[.]", "(.)", " dot ", "[dot]"]) if hard else ".").join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return kind, card(rng.choice([".", "/", "_", "  ", " - "]) if hard else rng.choice(["", " ", "-"]))
        if kind == "phone":
            return kind, rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}"]) if hard else f"+{num(2)} ({num(3)}) {num(3)}-{num(4)}"
        return kind, rng.choice([rng.choice(["password", "token", "api_key", "secret"]) + rng.choice(["=", ": "]) + num(3) + word() + num(5), "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))])

    def look_alike() -> str:
        return rng.choice([f"20{num(2)}-0{rng.randint(1, 9)}-1{num(1)}", f"{num(1)}.{num(1)}.{num(2)}", f"{num(3)},{num(3)}.{num(2)}", num(rng.randint(1, 12)), f"{num(2)}:{num(2)}", "9" * 13 + num(2), f"{num(4)} {num(4)}", "the dot", f"3{num(2)}.4{num(2)}.{num(3)}.9{num(2)}", f"{num(5)}-{num(7)}", f"{num(20)}", f"{num(4)}-{num(4)}", f"{num(3)} {num(3)} {num(2)}", f"no {num(8)}", f"{num(10)}", f"{word()}{num(9)}", "@" + word()])

    text, spans, cue = "", [], {"phone": "phone ", "card": "card ", "ip": "host ", "email": "mail ", "secret": ""}
    for _ in range(rng.randint(2, 4)):
        text += "".join(word() + " " for _ in range(rng.randint(1, 3)))
        if rng.random() < 0.5:
            kind, x = entity()
            text += cue[kind] if rng.random() < 0.4 else ""
            spans.append((kind, len(text), len(text) + len(x)))
            text += x + rng.choice([" ", ". ", ", "])
        else:
            text += look_alike() + " "
    return text + word(), spans


@lru_cache(maxsize=4)
def trained(sentences: int = 400, rounds: int = 6, seed: int = 11) -> Weights:
    rng, weights, data = random.Random(seed), {(k, "any"): -2.0 for k in KINDS}, []
    for _ in range(sentences):
        text, spans = _synthetic(rng)
        edges, ending = _candidates(text, 0, len(text))
        at = {e: k for k, e in enumerate(edges)}
        data.append((len(edges), ending, {(at[s], at[e], kind) for kind, s, e in spans if s in at and e in at}))
    for r in range(rounds):
        for n, ending, gold in data:
            _step(n, ending, gold, weights, 0.4 / (1 + r))
    return weights


class _Runs:
    """Where the run of letters and digits, or of blanks, at a place ends. The last run is remembered, so that many places of a long
    one cost one look."""

    def __init__(self, text: str):
        self.text, self.first, self.last = text, 0, 0

    def end(self, at: int) -> int:
        if not self.first <= at < self.last:
            self.first, self.last = at, _RUN.match(self.text, at).end()
        return self.last


def islands(text: str) -> list[tuple[int, int]]:
    """The parts of a text that hold all candidates: MOST_CHARS around each trigger, and whole unbounded shapes. Their edges are
    edges of the text's tokens."""
    found = [m.span() for m in _TRIGGER.finditer(text)]
    for shape in _UNBOUNDED:
        found += [m.span() for m in _SHAPES[shape].finditer(text)]
    out: list[list[int]] = []
    before, after = _Runs(text), _Runs(text)
    for a, b in sorted(found):
        lo, hi = max(0, a - MOST_CHARS), min(len(text), b + MOST_CHARS)
        if lo:
            lo = max(lo, before.end(lo - 1))  # no candidate begins so far before its trigger
        hi = max(hi, after.end(hi - 1))  # a run of letters and digits, or of blanks, isn't cut
        if lo >= hi:
            continue
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def find(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by kind and then start. Spans that the field finds over a base span are that one's, but for secrets,
    which may hold or meet one: what is around it is secret too. An assigned secret goes on to the next blank or quote, whatever
    else is in it, but for punctuation at its end."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    more, k, reached = [], 0, 0
    for lo, hi in islands(text):
        for kind, s, e in decode(text, lo, hi, weights):
            if e <= reached:
                continue
            if kind == "secret" and _SHAPES["assigned"].fullmatch(text, s, e):
                e = reached = e + len(_GOES_ON.match(text, e)[0].rstrip(".,;:!?)]>"))
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            over = takewhile(lambda n, e=e: n < len(taken) and taken[n][0] < e, count(k))
            if kind == "secret" or not any(s < taken[n][1] for n in over):
                more.append((kind, s, e))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return base, sorted(set(base + more), key=lambda x: (order[x[0]], x[1], x[2]))


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span, overlapping ones together, as a tag of the first one's kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): of each row of docs the patterns' spans and all spans, arrays of (kind, start, end) by kind and then
    start, in code points, end exclusive. A null text is empty and has none; ids may be null or repeat; rows stay apart."""
    weights = trained()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(x, weights) for x in texts(batch.column(1))]
        columns = [pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in f[k]] for f in found], _SPAN_TYPE) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "base", "spans"])

    kind = docs.select(id_col).dtypes[0][1]
    return map_columns(docs.select(id_col, text_col), run, f"id {kind}, base {_SPANS}, spans {_SPANS}")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents the numbers of base spans by kind, their digest, and all spans. A null text is empty: no span, and the
    digest of nothing. Repeated and null ids have a row each; an empty table gives none; other columns are not read."""
    found = spans(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *(number(k) for k in KINDS[:4]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced by tags like <EMAIL>; all other columns and null texts stay as they are."""
    weights, at, schema = trained(), docs.columns.index(text_col), docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = [x if x is None else redacted(x, find(x, weights)[1]) for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(column, batch.column(at).type), *batch.columns[at + 1 :]], names=batch.schema.names)

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                yield run(batch)

    return docs.mapInArrow(each, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: every row with its text redacted, and n_chars (code points) following it where there is such a
    column. Null texts stay null; repeated rows stay; all other columns, whatever their names, are as they were."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
