"""Near-duplicates by SimHash and the Jaccard similarity of word shingles, for the pipeline's stage (op9's query has a contract of its
own).

A text's set is the 64-bit hashes of its runs of SHINGLE words, ASCII letters lowered. Texts of equal sets are one class. A class's
fingerprint is the majority of its set's bits. Fingerprints are linked by simhash.links, through Golay keys and their Hamming
distance, and the classes so found together are held against the exact similarity first.

That alone would lose links: at a similarity of 0.8 fingerprints differ in about ten bits, more than Golay keys of 64 bits reach. So
classes are also filed under BANDS keys of ROWS minima each: a pair of similarity s shares none with probability
(1 - s^ROWS)^BANDS, 5e-8 at 0.8. Every pair filed together is held against the exact similarity, unless links, those of the
fingerprints among them, join it already."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import map_columns, mixed, raw_texts, run_hashes, word_hashes, written
from .components import components

#: Links are of similarity LINKED[0] / LINKED[1] and more.
SHINGLE, LINKED = 5, (4, 5)
BANDS, ROWS = 32, 4
#: Rounds that compare each class of a key with one of them, before all with all of those not joined yet.
STARS = 2
#: Classes under one key, and shingles in their sets together, that a task compares; larger groups are dealt out as pairs of tiles
#: of about this size (a set larger than that is a tile of its own size).
TILE, TILE_SHINGLES = 4096, 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's different shingles; a shorter text is one shingle, one without words has none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(word_hashes(words), min(size, len(words))))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set that isn't empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(found), 512):
        np.minimum(least, ((found[k : k + 512, None] ^ _SEEDS[0]) * _SEEDS[1]).min(0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ part)
    return key


def _class(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def _filed(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [shingles(x) for x in raw_texts(batch.column(1))]  # the third column is the text's digest
    cls = pa.array(np.array([_class(x) for x in found], np.uint64).view(np.int64), pa.int64())
    keys = pa.array([band_keys(x).view(np.int64) if len(x) else [] for x in found], pa.list_(pa.int64()))
    fp = pa.array(np.array([simhash.majority(x) for x in found], np.uint64).view(np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), cls, pa.array([len(x) for x in found], pa.int32()), fp, keys], names=["id", "text_md5", "cls", "n", "fp", "keys"])


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [shingles(x) for x in raw_texts(batch.column(0))]
    cls = pa.array(np.array([_class(x) for x in found], np.uint64).view(np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([cls, pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["cls", "found"])


def printed(classes: DataFrame) -> DataFrame:
    """(a, b, n, m): of classes (cls, n, fp) those that fingerprints put together, with their sets' sizes: each with the least class of
    its fingerprint, and the least ones of fingerprints linked. A fingerprint's classes aren't paired all with all; what that leaves
    unlinked is left to the other keys."""
    least = written(classes.groupBy("fp").agg(F.min(F.struct("cls", "n")).alias("c")).select("fp", F.col("c.cls").alias("b"), F.col("c.n").alias("m")), "near-fingerprints")
    alike = classes.join(least.hint("merge"), "fp").where("cls != b").select(F.col("cls").alias("a"), "b", "n", "m")
    linked = written(simhash.links(least.select("fp")).distinct(), "near-fingerprint-links")
    left, right = least.select(F.col("fp").alias("a"), F.col("b").alias("x"), F.col("m").alias("n")), least.select(F.col("fp").alias("b"), F.col("b").alias("y"), "m")
    across = linked.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "n", "m")
    return alike.unionByName(across)


def _rooted(filed: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, cls, n, root) of the keys whose classes links don't join yet."""
    roots = filed.join(components(linked).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    roots = written(roots.select("key", "cls", "n", "root"), "near-rooted")
    return roots.join(roots.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "key")


def links(filed: DataFrame, sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b): links that join the same classes as all pairs filed (key, cls, n) under one key, and the candidates (a, b, n, m), whose
    sets (cls, found) are similar enough. Candidates and rounds of stars join most; what they don't is compared all with all inside
    tasks, so no pair is left out."""
    x, y = sets.select(F.col("cls").alias("a"), F.col("found").alias("left")), sets.select(F.col("cls").alias("b"), F.col("found").alias("right"))
    p, q = LINKED

    def similar(pairs: DataFrame) -> DataFrame:
        sized = pairs.where(q * F.least("n", "m") >= p * F.greatest("n", "m")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        shared, both = F.size(F.array_intersect("left", "right")), F.size("left") + F.size("right")
        return written(sized.join(x, "a").join(y, "b").where(q * shared >= p * (both - shared)).select("a", "b"), "near-links")

    linked = similar(candidates)
    for k in range(STARS):
        open_keys = _rooted(filed, linked)
        centres = open_keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("root", F.lit(k)).alias("h"), F.xxhash64("cls", F.lit(k)).alias("g"), "cls", "n", "root")).alias("c"))
        pairs = open_keys.join(centres.select("key", F.col("c.cls").alias("b"), F.col("c.n").alias("m"), F.col("c.root").alias("other")), "key").where("root != other")
        linked = linked.unionByName(similar(pairs.select(F.col("cls").alias("a"), "b", "n", "m")))
    return linked.unionByName(written(_compared(_rooted(filed, linked), sets), "near-links"))


def _across(cls: np.ndarray, root: np.ndarray, found: list[np.ndarray]) -> list[tuple[int, int]]:
    """Of classes with their roots and sets the links between different roots, one for each two roots that have any. The shingles are
    sorted once; a class's shared ones with all others are counted from their places."""
    p, q = LINKED
    sizes = np.array([len(x) for x in found])
    flat, owner = np.concatenate(found), np.repeat(np.arange(len(cls), dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    roots, counts = np.unique(root, return_counts=True)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for k in np.flatnonzero(root != roots[np.argmax(counts)]):  # a pair of two roots has one that isn't in the largest
        lo, hi = np.searchsorted(flat, found[k], "left"), np.searchsorted(flat, found[k], "right")
        size = hi - lo
        places = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        shared = np.bincount(owner[places], minlength=len(cls))
        for y in np.flatnonzero((q * shared >= p * (sizes[k] + sizes - shared)) & (root != root[k])).tolist():
            out.setdefault((min(root[k], root[y]), max(root[k], root[y])), (int(cls[k]), int(cls[y])))
    return list(out.values())


def _compared(open_keys: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between classes of different roots under one key (key, cls, n, root), all with all. Pairs are made and held
    against the exact similarity inside a task, and only links leave it; a key with over TILE classes, or TILE_SHINGLES shingles in
    their sets, is dealt out by tile, each pair of tiles a group of its own, so a task's memory is bounded by two tiles' sets."""
    counts = open_keys.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / F.lit(TILE)), F.least(F.count("*"), F.ceil(F.sum("n") / F.lit(TILE_SHINGLES)))).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    dealt = open_keys.join(counts, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "cls", "root").join(sets, "cls").select("grp", "cls", "root", "found")

    def compare(batches):
        held: list[pa.Table] = []

        def done(t: pa.Table):
            grp = t.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]]))
            links = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                one = t.slice(a, b - a).combine_chunks()
                lists = one.column(3).combine_chunks()
                found = np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1])
                links += _across(one.column(1).to_numpy(), one.column(2).to_numpy(), found)
            if links:
                pair = np.array(links, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, k].copy(), pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= 2 * TILE or sum(t.column(3).nbytes for t in held) >= 2 * 8 * TILE_SHINGLES:
                whole = pa.concat_tables(held)
                grp = whole.column(0).to_numpy()
                cut = int(np.searchsorted(grp, grp[-1]))  # the last group may go on
                if cut:
                    yield from done(whole.slice(0, cut))
                held = [whole.slice(cut)]
        if held:
            yield from done(pa.concat_tables(held))

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(compare, "a long, b long")


def rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_md5, root): a row for each of docs, root the same for all rows that links join. A null text is an empty one."""
    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(id_col, text_col, F.md5(F.coalesce(text_col, F.lit(""))).alias("md5"))
    prints = written(map_columns(rows, _filed, f"id {kind}, text_md5 string, cls long, n int, fp long, keys array<long>"), "near-prints")
    distinct = written(prints.groupBy("cls").agg(F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")), "near-classes")
    every = distinct.select("cls", "n", F.explode("keys").alias("key"))
    filed = written(every.join(every.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "key").select("key", "cls", "n"), "near-filed")
    candidates = written(printed(distinct.select("cls", "n", "fp")), "near-candidates")
    of = map_columns(docs.select(text_col), _sets, "cls long, found array<long>")
    asked = filed.select("cls").unionByName(candidates.select(F.col("a").alias("cls"))).unionByName(candidates.select(F.col("b").alias("cls"))).distinct()
    sets = written(of.join(asked, "cls", "left_semi").groupBy("cls").agg(F.any_value("found").alias("found")), "near-sets")
    roots = components(links(filed, sets, candidates)).withColumnRenamed("node", "cls")
    known = written(distinct.select("cls").join(roots, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root")), "near-roots")
    return prints.join(known, "cls").select("id", "text_md5", "root")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): a row for each of docs, component_id the smallest id reachable by links, null ids as in simhash.clusters."""
    rows = written(rooted(docs, id_col, text_col), "near-rows")
    return rows.join(rows.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("id", "component_id")


def _row_key(id_col: str, md5: Column) -> Column:
    """A string for each pair of an id, which may be null, and a text."""
    return F.concat_ws(":", F.col(id_col).isNull().cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), md5)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay if one of each component does: the one with the smallest id (nulls are
    larger than all), of equal ids that with the smallest digest of its text, and of rows equal in both any, as a whole."""
    first = rooted(docs, id_col, text_col).groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_md5")).alias("f"))
    chosen = written(first.select(_row_key("f.id", F.col("f.text_md5")).alias("own")), "near-kept")
    rows = docs.select(_row_key(id_col, F.md5(F.coalesce(text_col, F.lit("")))).alias("own"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # One shuffle by own serves the join and the aggregation.
    return rows.join(chosen, "own", "left_semi").groupBy("own").agg(F.first("row").alias("row")).select("row.*")
