"""Toxicity by weak supervision.

1. Lexicon entries (words and word beginnings) are mined from a bounded sample of labelled rows: counted in Spark, the most
   telling ones kept.
2. Each entry and each of a few patterns is a voter: it votes toxic where it is found, else it abstains. A generative model of two
   classes estimates how often each voter fires in either class, by expectation maximisation, and the voters' correlations given
   the class; votes of correlated voters share their weight. The given labels are no voters: they choose the lexicon and set where the
   maximisation starts. It gives each sampled row a posterior label, which may differ from the given one.
3. A linear classifier is trained on the posterior labels; it alone scores texts.

The sample, the lexicon and the model are bounded by parameters. Scoring takes one pass over whole texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table, texts, written

#: Bounds: labelled rows of each label (toxic, clean) that are learnt from, and lexicon entries.
MOST_ROWS, MOST_ENTRIES = (4000, 6000), 600
#: An entry stands in this many toxic rows of the sample at least, and is this much likelier in toxic rows.
LEAST_ROWS, LEAST_LIFT = 3, 25.0
#: Lengths of word beginnings that can be entries.
BEGINNINGS = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-ZÀ-Þ]{3,}\b[^\w\n]+){4}"),
    "marks": re.compile(r"[!?]{3,}"),
    "addressed": re.compile(r"\b(?:you|your|du|dein|tu|toi|eres|vous) (?:are |bist |es |êtes )?(?:a |an |ein |un |une )?\w{3,}[!.]", re.I),
}


def entries(text: str) -> set[str]:
    """What a text can be counted under: its words as 'w:word' and word beginnings as 'p:begi'."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add("w:" + w)
        out.update("p:" + w[:k] for k in BEGINNINGS if len(w) > k)
    return out


def labelled(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = MOST_ROWS) -> DataFrame:
    """(text, toxic) of at most most[label] rows with each label, chosen by a hash of their id; none of those with
    crc32(doc_id) mod 5 = 0. A doc_id with several labels is toxic if one of them is, and of one with several texts the least is
    taken; null ids and labels are left out."""
    known = labels.where("doc_id is not null and toxic is not null and pmod(crc32(cast(doc_id as string)), 5) != 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[1 - y]) for y in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by most
    return docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic")).select("text", "toxic")


def mine(sample: DataFrame) -> list[str]:
    """The entries that tell toxic rows best: counted where the rows are, summed by a shuffle of counts."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = (Counter(), Counter())
        for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            n[int(y == 1)].update(entries(text))
        names = list(n[1])  # what no toxic row of the batch has can't be missed: clean counts are joined below
        names += [x for x, k in n[0].items() if x not in n[1] and k >= 1]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([n[y][x] for x in names], pa.int64()) for y in (0, 1))], names=["entry", "clean", "toxic"])

    rows = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = max(rows.get(0, 0), 1), max(rows.get(1, 0), 1)
    sums = map_columns(sample, count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = (F.col("toxic") / F.lit(n1)) / ((F.col("clean") + F.lit(0.5)) / F.lit(n0))
    best = sums.where(F.col("toxic") >= LEAST_ROWS).where(lift >= LEAST_LIFT).orderBy(F.desc(F.col("toxic") * F.log(lift)), "entry").limit(MOST_ENTRIES)
    return pruned([tuple(r) for r in best.select("entry", "toxic", "clean").collect()])


def pruned(rows: list[tuple[str, int, int]]) -> list[str]:
    """The entries of (entry, toxic rows, clean rows) without those that say no more than another: a beginning of which one
    longer entry has nearly all toxic rows, and no more clean ones; an entry of which a shorter beginning is as pure."""
    out = []
    for e, toxic, clean in rows:
        longer = any(o != e and o[2:].startswith(e[2:]) and (len(o) > len(e) or o[0] == "w") and t >= 0.9 * toxic and c <= clean for o, t, c in rows)
        shorter = any(o[0] == "p" and len(o) < len(e) and e[2:].startswith(o[2:]) and t * (clean + 1) >= toxic * (c + 1) and t >= 1.2 * toxic for o, t, c in rows)
        if not longer and not shorter:
            out.append(e)
    return out


@dataclass
class Model:
    entries: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -2.0

    def matcher(self) -> Matcher:
        return Matcher(self.entries)

    def score(self, present: list[int]) -> float:
        z = self.bias + float(self.weights[present].sum()) if present else self.bias
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


class Matcher:
    """Finds the entries and patterns of a text in one pass (Aho-Corasick over its lower-case form)."""

    def __init__(self, entries: list[str]):
        import ahocorasick

        self.size = len(entries)
        by: dict[str, list[tuple[int, bool]]] = {}
        for k, e in enumerate(entries):
            by.setdefault(e[2:], []).append((k, e[0] == "w"))
        self.automaton = ahocorasick.Automaton()
        for s, owners in by.items():
            self.automaton.add_word(s, (len(s), owners))
        self.any = bool(by)
        if self.any:
            self.automaton.make_automaton()

    def present(self, text: str) -> list[int]:
        """Indices of entries, then of patterns, that the text has."""
        out: set[int] = set()
        if self.any:
            low = text.lower()
            for end, (n, owners) in self.automaton.iter(low):
                start = end + 1 - n
                if start and low[start - 1].isalpha():
                    continue
                goes_on = end + 1 < len(low) and low[end + 1].isalpha()
                out.update(k for k, whole in owners if whole != goes_on)
        out.update(self.size + k for k, p in enumerate(_PATTERNS.values()) if p.search(text))
        return sorted(out)


@dataclass
class LabelModel:
    """What label_model() estimates: each row's posterior of toxic; how often each voter fires in the clean and in the toxic class;
    how sure its vote is (the mean posterior where it fires); and the voters' correlations given the class."""

    posterior: np.ndarray
    rate: np.ndarray
    accuracy: np.ndarray
    correlation: np.ndarray


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 15, least_correlation: float = 0.2, least_lift: np.ndarray | float = 0.0) -> LabelModel:
    """The generative model of votes (rows x voters: 1 fires, 0 abstains), by expectation maximisation from the posterior start.

    Given the class, voters whose residual votes correlate by over least_correlation (and over what chance gives few rows) aren't
    independent: what a vote says is divided by one plus the sum of its correlations with the votes that are the same in that row.
    The correlations are found from the first posteriors and again halfway. least_lift: how much oftener a voter fires in toxic rows
    at least, where that is known of it; without it the two classes could settle on another split of the rows."""
    v, q = votes.astype(np.float64), start.astype(np.float64)
    rate, c = np.zeros((2, v.shape[1])), np.zeros((v.shape[1], v.shape[1]))
    same, other = np.zeros_like(v), np.zeros_like(v)
    prior = float(np.clip(start.mean(), 0.01, 0.99))  # the classes' balance is known; voters that all say toxic don't tell it
    for r in range(rounds):
        for y, w in ((1, q), (0, 1 - q)):
            rate[y] = (w @ v + 0.5) / (w.sum() + 1)
        rate[0] = np.where(np.asarray(least_lift) > 0, np.minimum(rate[0], rate[1] / np.maximum(least_lift, 1e-9)), rate[0])
        if r in (0, rounds // 2) and v.shape[1] > 1:
            rest = v - (q[:, None] * rate[1] + (1 - q)[:, None] * rate[0])
            rest -= rest.mean(0)
            spread = rest.std(0)
            rest = np.where(spread > 0.02, rest / np.maximum(spread, 0.02), 0.0)  # what the class explains is no correlation
            c = np.minimum(rest.T @ rest / len(v), 1.0)
            np.fill_diagonal(c, 0)
            c[c <= least_correlation + 4 / math.sqrt(len(v))] = 0
            same = v @ c  # with the voters that fire in the row
            other = c.sum(1) - same  # with those that abstain
        fires, abstains = np.log(rate[1]) - np.log(rate[0]), np.log1p(-rate[1]) - np.log1p(-rate[0])
        z = math.log(prior / (1 - prior)) + (v * fires / (1 + same)).sum(1) + ((1 - v) * abstains / (1 + other)).sum(1)
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return LabelModel(q, rate, (v.T @ q) / np.maximum(v.sum(0), 1e-9), c)


def _regression(x: np.ndarray, q: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    w, b, vw, vb = np.zeros(x.shape[1]), -2.0, np.zeros(x.shape[1]), 0.0
    rate = 4.0 / max(1.0, float((x * x).sum(1).mean()) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        vw = 0.9 * vw - rate * (x.T @ (p - q) / len(q) + decay * w)
        vb = 0.9 * vb - rate * float((p - q).mean())
        w, b = w + vw, b + vb
    return w, b


def found_in(sample: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(votes: rows x entries and patterns, given labels) of a sample (text, toxic), which labelled() bounds."""
    held: list[Matcher] = []

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Matcher(names))
        found = [held[0].present(x) for x in texts(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["found", "toxic"])

    rows = map_columns(sample, look, "found array<int>, toxic int").toArrow().to_pydict()  # bounded by most and the lexicon
    x = np.zeros((len(rows["toxic"]), len(names) + len(_PATTERNS)), np.float32)
    for k, found in enumerate(rows["found"]):
        x[k, found] = 1
    return x, np.array([int(y == 1) for y in rows["toxic"]], np.int8)


def covering(x: np.ndarray, given: np.ndarray, n_entries: int) -> list[int]:
    """The entries, best first, that stand in LEAST_ROWS toxic rows of the sample in which no better one does: words that only copies
    of one text share add nothing to the words that make it toxic."""
    open_rows, out = x[given == 1, :n_entries] > 0, []
    free = np.ones(len(open_rows), bool)
    for k in range(n_entries):
        if (open_rows[:, k] & free).sum() >= LEAST_ROWS:
            out.append(k)
            free &= ~open_rows[:, k]
    return out


def learnt(x: np.ndarray, given: np.ndarray, n_entries: int) -> tuple[np.ndarray, float, LabelModel]:
    """(weights, bias, label model): a linear classifier of votes, trained on the label model's posteriors. The first n_entries
    voters were mined for their lift."""
    lift = np.where(np.arange(x.shape[1]) < n_entries, LEAST_LIFT, 0.0)
    model = label_model(x, 0.02 + 0.96 * given, least_lift=lift)
    return *_regression(x.astype(np.float64), model.posterior), model


def fit(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = MOST_ROWS) -> Model:
    """The model for docs, learnt from labels. Without a toxic label there is nothing to mine and every score is the same, low."""
    sample = written(labelled(docs, labels, most), "toxicity-sample")
    names = mine(sample)
    x, given = found_in(sample, names)
    if not given.any():
        return Model([], np.zeros(len(_PATTERNS)))
    kept = covering(x, given, len(names))
    weights, bias, _ = learnt(np.concatenate([x[:, kept], x[:, len(names) :]], 1), given, len(kept))
    return Model([names[k] for k in kept], weights, bias)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs; a null text is empty and gets the score of a text without any feature."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_ENTRIES
    held: list[Matcher] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(shared.value.matcher())
        found = [shared.value.score(held[0].present(x)) for x in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return map_columns(docs.select("doc_id", "text"), run, f"doc_id {docs.select('doc_id').dtypes[0][1]}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents held_out, score and predicted. A null text is empty and scored so; rows with repeated or null ids (these
    are not held out) each get their own; an empty table gives none; without labels all scores are the same, low."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0"), F.lit(False))
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: rows with a score under 0.5, with all their columns, whatever their names. Null and empty texts are
    scored as texts without a feature; repeated rows go or stay alike; an empty table stays empty."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    shared, at, schema = spark.sparkContext.broadcast(model), docs.columns.index("text"), docs.schema
    held: list[Matcher] = []

    def run(batches):
        for batch in batches:
            if not held:
                held.append(shared.value.matcher())
            keep = [shared.value.score(held[0].present(x)) < 0.5 for x in texts(batch.column(at))]
            if any(keep):
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
