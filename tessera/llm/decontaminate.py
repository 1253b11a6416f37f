"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

Words are lower-cased runs of letters and digits. A fixed mask takes some of nine consecutive words and ignores the others; its
hash at each place of a test item joins its hash at each place of a document. A hit fixes an alignment of item and document,
whose words are then compared: a document holds an item if some window of 20 item words (the whole item if shorter) has 16 or
more equal words in place. The masks are chosen so that any window with that many equal words has a hit: MASKS cover every
choice of 4 places in 20 (tests enumerate them); tolerance() gives the same for shorter items."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

MASKS = ((0, 3, 4, 5, 6, 7), (0, 1, 2, 3, 6, 8), (0, 3, 4, 5, 7, 8))
SPAN = 9
#: Words of a compared window, and how many of them may differ.
WINDOW, MOST_DIFFERENT = 20, 4
#: Seeds (rows of 32 bytes) that are broadcast; with more, seeds and documents are shuffled by hash.
MOST_BROADCAST = 2_000_000


@lru_cache(maxsize=64)
def tolerance(n: int) -> int:
    """How many of a window's n words may differ: a fifth, or as many as the masks can't miss. Under SPAN words: none."""
    if n < SPAN:
        return 0
    most = min(MOST_DIFFERENT, n // 5)
    while most and not all(any(all(s + o not in bad for o in m) for m in MASKS for s in range(n - m[-1])) for bad in map(set, combinations(range(n), most))):
        most -= 1
    return most


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _masks(shorter: list[int]) -> list[tuple[int, ...]]:
    """The masks, and one without gaps for each length of items with fewer than SPAN words."""
    return [*MASKS, *(tuple(range(n)) for n in shorter)]


def _keys(shorter: list[int]) -> Column:
    """Per place, each mask's hash; null where the text ends before it. Columns w0, w1, ... are the words from the place on."""
    return F.array(*(F.when(F.col(f"w{m[-1]}").isNotNull(), F.xxhash64(F.lit(k), *(F.col(f"w{o}") for o in m))) for k, m in enumerate(_masks(shorter))))


def _places(rows: DataFrame, shorter: list[int]) -> DataFrame:
    """rows (with h, array of word hashes) once for each place and mask: with pos and key."""
    zipped = F.arrays_zip(*(F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))).alias(f"w{k}") for k in range(SPAN)))
    names = rows.columns
    at = rows.select(*names, F.posexplode(zipped).alias("pos", "w"))
    words = at.select(*names, "pos", *(F.col("w").getField(f"w{k}").alias(f"w{k}") for k in range(SPAN)))
    return words.select(*names, "pos", F.explode(_keys(shorter)).alias("key")).where("key is not null")


def _aligned(h: str, diagonal: Column, n: str) -> Column:
    """The document's words at the item's places, null where the document has none."""
    before = F.least(F.greatest(-diagonal, F.lit(0)), F.col(n))
    return F.concat(F.array_repeat(F.lit(None).cast("long"), before), F.slice(h, F.greatest(diagonal, F.lit(0)) + 1, F.col(n) - before))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(id, item, n_words, n_equal, n_window_equal): a row for each document id and item that it holds, with the item's number of words, the
    equal ones in the best alignment and in its best window. Null and empty texts and items hold nothing and are in nothing;
    rows with the same id count together; a null id is an id of its own; items with the same words are all reported."""
    named = items.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text)).alias("ih")).where("size(ih) > 0")
    by_words = written(named.groupBy("ih").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("unnamed")).withColumn("n", F.size("ih")).withColumn("group", F.xxhash64("ih")), "items")
    lengths = sorted(r[0] for r in by_words.select("n").distinct().where(f"n < {WINDOW}").collect())  # at most WINDOW - 1 numbers
    shorter = [n for n in lengths if n < SPAN]
    enough = F.lit(WINDOW - MOST_DIFFERENT)
    for n in lengths:
        enough = F.when(F.col("n") == n, n - tolerance(n)).otherwise(enough)

    own = _places(by_words.select("group", "n", F.col("ih").alias("h")), shorter)
    # A gapless mask of n words is for items of n words alone, and those have no other whole mask.
    seeds = written(own.select("group", "n", F.col("pos").alias("ipos"), "key").distinct(), "seeds")
    small = seeds.count() <= most_broadcast
    hashed = docs.select(F.col(id_col).alias("id"), word_hashes(F.col(text_col)).alias("h"))
    diagonal = F.col("pos") - F.col("ipos")
    if small:
        hits = _places(hashed, shorter).join(F.broadcast(seeds), "key").select("id", "group", "n", _aligned("h", diagonal, "n").alias("dh")).distinct()
    else:
        places = _places(hashed, shorter).select("id", "pos", "key")
        found = places.join(seeds, "key").select("id", "group", "n", diagonal.alias("diagonal")).distinct()
        hits = found.withColumnRenamed("id", "fid").join(hashed, F.col("fid").eqNullSafe(F.col("id"))).select("id", "group", "n", _aligned("h", F.col("diagonal"), "n").alias("dh")).distinct()
    equal = F.zip_with("dh", "ih", lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    compared = hits.join(by_words.select("group", "ih", "items", "unnamed"), "group").select("id", "items", "unnamed", "n", equal.alias("eq"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - WINDOW, F.lit(0)) + 1), lambda k: total(F.slice("eq", k, WINDOW)))
    judged = compared.select("id", "items", "unnamed", "n", total(F.col("eq")).alias("n_equal"), F.array_max(windows).alias("in_window"), enough.alias("enough")).where("in_window >= enough")
    listed = F.when(F.col("unnamed"), F.concat("items", F.array(F.lit(None)))).otherwise(F.col("items"))
    each = judged.select("id", "n", "n_equal", "in_window", F.explode(listed).alias("item"))
    return each.groupBy("id", "item").agg(F.max("n").cast("long").alias("n_words"), F.max("n_equal").cast("long").alias("n_equal"), F.max("in_window").cast("long").alias("n_window_equal"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_words, n_equal, n_window_equal) of all documents that hold a benchmark item."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_words", "n_equal", "n_window_equal")


_ENOUGH = " ".join(f"WHEN n = {n} THEN {n - tolerance(n)}" for n in range(4, WINDOW))

#: The same by shared runs of four words, which any window with enough equal words has (items of four words and more).
OP5_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS v FROM benchmark),
    dg AS (SELECT doc_id, p, concat_ws(' ', w[p], w[p + 1], w[p + 2], w[p + 3]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM d)),
    bg AS (SELECT item_id, p, concat_ws(' ', v[p], v[p + 1], v[p + 2], v[p + 3]) AS g FROM (SELECT item_id, v, unnest(range(1, len(v) - 2)) AS p FROM b)),
    c AS (SELECT DISTINCT doc_id, item_id, dg.p - bg.p AS diagonal FROM dg JOIN bg USING (g)),
    i AS (SELECT doc_id, item_id, diagonal, len(v) AS n, w, v, unnest(range(1, len(v) + 1)) AS k FROM c JOIN d USING (doc_id) JOIN b USING (item_id)),
    e AS (SELECT doc_id, item_id, diagonal, n, k, CASE WHEN k + diagonal >= 1 AND w[k + diagonal] = v[k] THEN 1 ELSE 0 END AS eq FROM i),
    s AS (SELECT *, sum(eq) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY k ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS win FROM e),
    m AS (SELECT doc_id, item_id, diagonal, n, sum(eq) AS total, max(win) FILTER (k <= greatest(n - {WINDOW}, 0) + 1) AS best FROM s GROUP BY ALL)
    SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS n_words, CAST(max(total) AS BIGINT) AS n_equal, CAST(max(best) AS BIGINT) AS n_window_equal
    FROM m WHERE best >= CASE {_ENOUGH} ELSE {WINDOW - MOST_DIFFERENT} END GROUP BY doc_id, item_id"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that hold no benchmark item, with all their columns."""
    found = overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("id").alias("__held_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__held_id"]), "left_anti")
