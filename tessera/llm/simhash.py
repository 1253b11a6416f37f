"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits, padded to words of the binary Golay code of length 23. Two
fingerprints with at most three differing bits agree, by pigeonhole, in one of two ways:

* some segment is equal and another differs in at most one bit; or
* each segment differs in exactly one bit.

Two segment words at distance at most one have different parities or are equal. The odd word's keys are the 12-bit indices of
the codewords that it and its one-bit neighbours decode to (the code is perfect: every word decodes to one codeword within three
bits); the even word's only key is that of the codeword it decodes to itself. So words at distance at most one share a key. A
fingerprint is filed under (equal segment, key of another) for each ordered pair of segments, and under (key, key, key) for all
three. Fingerprints filed together are verified by their Hamming distance; every link within three bits is found."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, raw_texts, table, written
from .components import components

MOST_BITS = 3
SHINGLE = 3
#: (shift, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints under one key that one task compares all with all; larger groups are dealt out as pairs of tiles this size.
TILE = 4096

_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the binary Golay code of length 23

# ---------------------------------------------------------------- fingerprints

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def majority(h: np.ndarray) -> int:
    """64 bits: bit k is set if over half of h have it. Of none: 0."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        total += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes) -> int:
    """The 64 bits of a text's UTF-8: those that over half of its shingles' hashes have. No word: 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts, ends = [0, *(ends[:-SHINGLE] + 1).tolist()], ends[SHINGLE - 1 :].tolist()
    return majority(np.array([digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): a row for each of docs; fp is the fingerprint's bits as a long. A null text has none set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x) for x in raw_texts(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    kind = docs.select(id_col).dtypes[0][1]
    return map_columns(docs.select(id_col, text_col), run, f"id {kind}, fp long")


# ---------------------------------------------------------------- Golay code


def _remainder(word: np.ndarray) -> np.ndarray:
    """The 11-bit syndrome: word(x) mod the generator."""
    word = word.astype(np.int64)
    for bit in range(22, 10, -1):
        word = np.where(word >> bit & 1, word ^ (_GENERATOR << (bit - 11)), word)
    return word


@lru_cache(maxsize=1)
def error_patterns() -> np.ndarray:
    """The error (0 to 3 bits of 23) of each of the 2048 syndromes."""
    ones = [1 << i for i in range(23)]
    words = [0, *ones, *(a | b for a in ones for b in ones if a < b), *(a | b | c for a in ones for b in ones if a < b for c in ones if b < c)]
    out = np.full(2048, -1, np.int64)
    out[_remainder(np.array(words))] = words
    assert len(words) == 2048 and (out >= 0).all(), "the code is perfect"
    return out


@lru_cache(maxsize=1)
def codeword_index() -> np.ndarray:
    """For each 23-bit word the 12-bit index of the codeword that it decodes to: the codeword's upper bits (8 M entries, from
    the rule above, 2 bytes each)."""
    units, errors, out = [int(_remainder(np.array([1 << bit]))[0]) for bit in range(23)], error_patterns().astype(np.int32), np.empty(1 << 23, np.uint16)
    for start in range(0, 1 << 23, 1 << 18):  # in parts, so that a worker needs little besides the table
        words = np.arange(start, start + (1 << 18), dtype=np.int32)
        syndromes = np.zeros(1 << 18, np.int32)
        for bit, unit in enumerate(units):
            syndromes ^= (words >> bit & 1) * np.int32(unit)
        out[start : start + (1 << 18)] = (words ^ errors[syndromes]) >> 11
    return out


def segment_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the distinct Golay keys of segment words, by row: one for words of even parity."""
    index = codeword_index()
    odd = np.flatnonzero(np.bitwise_count(words) & 1)
    neighbours = words[odd, None] ^ np.concatenate([[0], 1 << np.arange(bits)])[None, :]
    keys = np.sort(index[neighbours], 1)
    new = np.concatenate([np.ones((len(odd), 1), bool), keys[:, 1:] != keys[:, :-1]], 1)
    even = np.flatnonzero(~(np.bitwise_count(words) & 1).astype(bool))
    row = np.concatenate([np.repeat(odd, new.sum(1)), even])
    key = np.concatenate([keys[new], index[words[even]]]).astype(np.int64)
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def _paired(row_a: np.ndarray, key_a: np.ndarray, row_b: np.ndarray, key_b: np.ndarray, n: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Both sides sorted by row: every combination of a row's keys, as (row, key_a << shift | key_b)."""
    count = np.bincount(row_b, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    times = count[row_a]
    at = np.repeat(first[row_a], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(row_a, times), np.repeat(key_a, times) << shift | key_b[at]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of fingerprints (unsigned); keys of different ways differ in their upper bits."""
    segments = [((fp >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    coded = [segment_keys(x, b) for x, (_, b) in zip(segments, SEGMENTS, strict=True)]
    rows, keys = [], []
    for i, exact in enumerate(segments):
        for j in range(3):
            if i != j:
                row, key = coded[j]
                rows.append(row)
                keys.append((3 * i + j + 1) << 40 | exact[row] << 12 | key)
    row, key = _paired(*coded[0], *coded[1], len(fp), 12)
    row, key = _paired(row, key, *coded[2], len(fp), 12)
    return np.concatenate([*rows, row]), np.concatenate([*keys, key])


# ---------------------------------------------------------------- links


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links (indices) that join the same fingerprints as all links within MOST_BITS: a search tree of each component. A
    fingerprint is compared with those not yet reached only."""
    out, rest = [], np.arange(len(fp))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]) <= MOST_BITS
            out += [(x, y) for y in rest[near]]
            queue += rest[near].tolist()
            rest = rest[~near]
    return out


def _links(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups of rows sorted by group. Small groups are compared all at once, row by row distance."""
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, int)
    size = np.diff(edge)
    a, b = [], []
    small = np.repeat(size <= 16, size)
    g, f = group[small], fp[small]
    for d in range(1, 16):
        if len(g) <= d:
            break
        hit = np.flatnonzero((g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= MOST_BITS))
        a.append(f[hit])
        b.append(f[hit + d])
    for k in np.flatnonzero(size > 16):
        x = fp[edge[k] : edge[k + 1]]
        if pairs := _forest(x):
            p = np.array(pairs)
            a.append(x[p[:, 0]])
            b.append(x[p[:, 1]])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) fingerprints within MOST_BITS of each other, enough to join all that are so linked; distinct has one row per
    fingerprint (fp). A key's fingerprints are counted first; those of a key with over TILE are dealt out by tile, each pair
    of tiles a group of its own, so no group holds more than two tiles however common a key is."""

    def file(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        parts = [(row + k, key) for k in range(0, len(fp), 4096) for row, key in [fuzzy_keys(fp[k : k + 4096])]]
        row, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp[row].view(np.int64), pa.int64())], names=["key", "fp"])

    every = map_columns(distinct.select("fp"), file, "key long, fp long")
    shared = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    filed = every.join(shared.hint("merge"), "key")  # nothing that grows with the rows passes through the driver
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (
        filed.withColumn("tiles", tiles)
        .withColumn("own", F.when(F.col("tiles") == 1, F.lit(0)).otherwise(own))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "fp")
    )

    def compare(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(group, fp):
            a, b = _links(group, fp)
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, k].copy().view(np.int64), pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((group, fp))
            if sum(len(x[0]) for x in held) > 200_000:
                group, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                yield from done(group[:cut], fp[:cut])
                held = [(group[cut:], fp[cut:])]
        if held:
            yield from done(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(compare, "a long, b long")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): a row for each of docs, component_id the smallest id reachable by links. Rows with equal
    fingerprints are one class and aren't expanded; only distinct fingerprints are filed and linked. Null ids are in a component
    as others are, but no component's smallest id; a component of null ids alone has null."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct))
    known = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = written(known, "rooted-fingerprints")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = known.join(smallest.hint("merge"), "root").select("fp", "component_id")
    return prints.join(by_fp.hint("merge"), "fp").select("id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its fingerprint and the smallest doc_id of its component."""
    out = clusters(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each component of near-duplicates (near.rooted: fingerprints of five-word shingles, filed under Golay
    keys, and an exact similarity of 0.8 and more) one row with all its columns, that of the smallest doc_id. Rows with one doc_id and unlike texts are judged apart; null texts are
    empty, and all empty texts are alike; a component whose ids are all null keeps one; an empty table stays empty."""
    from . import near  # which takes fingerprints and their links from here

    return near.kept(docs)
