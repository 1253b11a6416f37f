"""Exact substring removal with a compressed FM-index per shard.

A window is WINDOW consecutive words. A window's key is the smallest hash of its ANCHOR-word runs, so equal windows have equal keys
whatever stands around them. The steps, each over all rows:

1. every document's keys; those that only one document has are dropped (a minimum and a maximum by key);
2. runs of windows with a key that is left become units of text, which go to the shard of their key with the smallest doc_id
   that has them; equal units are one. Of a key with over MOST_UNITS units each window goes by its own hash instead, so no
   passage, however common, and whatever surrounds its copies, gathers in one shard;
3. a key of which one unit is left needs no search: no other unit can have its windows. The other units of a shard, as numbers of its words, are indexed (fmindex), and streamed through the index: matching statistics give at
   each word how far the text from there on stands in a unit of a smaller doc_id too; where that is WINDOW words and more the
   word is reported, in intervals;
4. these are the starts of the repeated windows of the unit's first document; of any later document with the unit all windows are.
   Documents drop the words under them.

Hashes choose keys and shards only, so equal hashes of different words cost time and change nothing: the index holds words by
exact number, and units meet their results by SHA-256."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_array, map_columns, raw_texts, run_hashes, table, word_hashes, written
from .fmindex import Index, matching_statistics

WINDOW, ANCHOR = 50, 12
#: Windows of a unit, units of one key that stay together, and words that a shard indexes (about 200 bytes each).
MOST_WINDOWS, MOST_UNITS, SHARD_WORDS = 64, 20_000, 1_000_000

def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def window_keys(words: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The key of each window of word hashes."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    return sliding_min(run_hashes(words, anchor), window - anchor + 1).view(np.int64)


def repeated(units: list[bytes], ids: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each unit (words joined by one space) the intervals [from, to) of its words at which its matching statistics against
    the units with smaller ids are window and more."""
    words = b" ".join(units).split()
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    sizes = np.array([u.count(b" ") + 1 for u in units])
    ends = np.cumsum(sizes)
    found = matching_statistics(Index(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), ends, ids)) >= window
    change = np.diff(np.concatenate([[False], found, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)  # a unit's last words reach no window, so none joins two
    of = np.searchsorted(ends, begin, side="right")
    spans = np.stack([begin, end], 1) - (ends - sizes)[of][:, None]
    return np.split(spans, np.cumsum(np.bincount(of, minlength=len(units)))[:-1])


# ---------------------------------------------------------------- tables

_UNIT = "key long, doc_id long, tie long, start long, n long, words binary"


def _keys(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    docs, ties, keys = [], [], []
    for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
        found = np.unique(window_keys(word_hashes(text.split())))
        docs.append(np.full(len(found), doc))
        ties.append(np.full(len(found), tie))
        keys.append(found)
    columns = [long_array(np.concatenate(x)) for x in (docs, ties, keys)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "key"])


def _units(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Runs of at most MOST_WINDOWS windows with one key that is among the document's kept keys."""
    rows: list[tuple] = []
    for doc, tie, text, kept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
        words = text.split()
        keys = window_keys(word_hashes(words))
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(cut, len(keys)))
        for s, n in zip(cut[good := np.isin(keys[cut], kept)].tolist(), size[good].tolist(), strict=True):
            for at in range(s, s + n, MOST_WINDOWS):
                m = min(MOST_WINDOWS, s + n - at)
                rows.append((int(keys[s]), doc, tie, at, m, b" ".join(words[at : at + m + WINDOW - 1])))
    return _unit_batch(rows)


def _unit_batch(rows: list[tuple]) -> pa.RecordBatch | None:
    if not rows:
        return None
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names=["key", "doc_id", "tie", "start", "n", "words"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units as single windows, keyed by their own hash."""
    for batch in batches:
        for chunk in range(0, batch.num_rows, 1000):
            rows: list[tuple] = []
            for _, doc, tie, start, n, text in zip(*(c.to_pylist() for c in batch.slice(chunk, 1000).columns), strict=True):
                words = text.split()
                keys = run_hashes(word_hashes(words), WINDOW).view(np.int64).tolist()
                rows += [(keys[k], doc, tie, start + k, 1, b" ".join(words[k : k + WINDOW])) for k in range(n)]
            if rows:
                yield _unit_batch(rows)


def _search(shard: pa.Table) -> pa.Table:
    """One shard's units (words, first id, digest) through its index."""
    found = repeated(shard.column("words").to_pylist(), shard.column("first").to_numpy())
    lists = pa.array([[{"a": a, "b": b} for a, b in x.tolist()] for x in found], _SPANS)
    return pa.table([shard.column("digest"), shard.column("first"), lists], schema=_FOUND)


_SPANS_SQL = "array<struct<a:long,b:long>>"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_FOUND = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("spans", _SPANS)])


def marks(docs: DataFrame, most_units: int = MOST_UNITS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, tie, starts array<struct<a, b>>): the windows (intervals of their first words) of docs (doc_id, tie, text) that
    start in a document with a smaller doc_id too. Rows with null ids have no marks and mark nothing."""
    rows = docs.where("doc_id is not null")
    keys = written(map_columns(rows.select("doc_id", "tie", "text"), _keys, "doc_id long, tie long, key long"), "window-keys")
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    kept = keys.join(shared, "key").groupBy("doc_id", "tie").agg(F.collect_set("key").alias("keys"))  # at most a document's windows
    units = written(map_columns(rows.select("doc_id", "tie", "text").join(kept, ["doc_id", "tie"]), _units, _UNIT), "units")
    often = units.groupBy("key").count().where(F.col("count") > most_units).select("key", F.lit(True).alias("often"))
    often = written(often, "often")
    if not often.isEmpty():
        flagged = units.join(often, "key", "left")
        singles = flagged.where("often").drop("often").mapInArrow(_single, _UNIT)
        units = written(flagged.where("often is null").drop("often").unionByName(singles), "units")
    digest = F.unhex(F.sha2("words", 256)).alias("digest")
    distinct = written(units.groupBy("key", digest).agg(F.min("doc_id").alias("first"), F.any_value("n").alias("n"), F.any_value("words").alias("words")), "distinct-units")
    alone = distinct.groupBy("key").agg(F.count("*").alias("k")).where("k = 1").select("key", F.lit(True).alias("alone"))
    flagged = distinct.join(alone, "key", "left")
    words = flagged.where("alone is null").select((F.sum("n") + (WINDOW - 1) * F.count("*")).alias("n")).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    dealt = flagged.where("alone is null").select(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(shards)).alias("shard"), "words", "first", "digest")
    found = dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_search, f"digest binary, first long, spans {_SPANS_SQL}")
    found = found.unionByName(flagged.where("alone").select("digest", "first", F.array().cast(_SPANS_SQL).alias("spans")))
    places = units.select("doc_id", "tie", "start", "n", digest).join(found, "digest")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    own = F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("spans"))
    moved = F.transform(own, lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))
    return places.select("doc_id", "tie", moved.alias("s")).where("size(s) > 0").groupBy("doc_id", "tie").agg(F.flatten(F.collect_list("s")).alias("starts"))


def kept_words(text: bytes, starts: list[dict] | None) -> tuple[int, list[bytes]]:
    """(number of words, those that no window with a marked start covers)."""
    words = text.split()
    if not starts:
        return len(words), words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [s["a"] for s in starts], 1)
    np.add.at(change, [s["b"] + WINDOW - 1 for s in starts], -1)
    bare = np.cumsum(change)[: len(words)] == 0
    return len(words), [words[k] for k in np.flatnonzero(bare).tolist()]


def marked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with starts, the marked windows of each row, null where none."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    found = marks(rows)
    return rows.join(found, ["doc_id", "tie"], "left").select("doc_id", "text", "starts")


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of each row of docs (doc_id, text): the text without repeated words, those that are
    kept joined by one space. A null text has no words; rows with the same doc_id are rows of one document, each with its own
    result; a null doc_id is smaller than none and keeps all."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, out = [], [], []
        for text, starts in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            size, kept = kept_words(text, starts)
            n.append(size)
            gone.append(size - len(kept))
            out.append(b" ".join(kept).decode())
        return pa.RecordBatch.from_arrays([batch.column(0), long_array(n), long_array(gone), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return map_columns(marked(docs.select(F.col("doc_id").cast("long"), "text")), run, "doc_id long, n_words long, n_removed long, text string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document n_words, n_removed and the digest of the kept words."""
    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The same by the windows' whole texts.
OP6_SQL = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    k AS (SELECT doc_id, s, array_to_string(ws[s:s + {WINDOW - 1}], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS s FROM w)),
    f AS (SELECT t, min(doc_id) AS first_id FROM k GROUP BY t),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS i FROM k JOIN f USING (t) WHERE first_id < doc_id),
    g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
        sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
    FROM w LEFT JOIN g USING (doc_id)"""
