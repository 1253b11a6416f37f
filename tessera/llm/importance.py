"""Importance resampling towards a target: documents drawn by hashed n-gram weights and Gumbel noise.

Identical texts are one class: classes come from grouping by the full text, their features and weight are made once, and their
counts go into the corpus totals times their multiplicity. Weights are joined back to the documents before noise, which is by
doc_id, is added. What meets in one place is a vector of one number a bucket (BUCKETS, a parameter)."""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_array, raw_texts, table, written

#: Words in a feature at most; buckets of features; smoothing comes to one a bucket.
NGRAM, BUCKETS = 1, 10_000
#: Documents of fewer words aren't drawn; so many in a hundred of the others are.
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"

#: A-Z lowered; ASCII that is neither a letter nor a digit separates. Bytes of other characters stay, so whole characters do.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words whose bucket a task remembers.
_KNOWN = 1 << 18


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def features(found: list[bytes], ngram: int = NGRAM, buckets: int = BUCKETS, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The bucket of each feature of a list of words: its runs of 1 to ngram words, joined by a space, repeats included."""
    known = {} if known is None else known
    out = []
    for n in range(1, min(ngram, len(found)) + 1):
        for run in found if n == 1 else (b" ".join(found[k : k + n]) for k in range(len(found) - n + 1)):
            at = known.get(run)
            if at is None:
                at = crc32(run) % buckets
                if len(known) < _KNOWN:
                    known[run] = at
            out.append(at)
    return np.array(out, np.int64)


def classes(docs: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(digest, n, n_words, n_features, at, times): a row for each different text of docs, n how many rows have it, at and times its
    buckets and how often each occurs (at most one of each bucket, however long the text). A null text is the empty one. digest is
    SHA-256 of the text, for joins; classes themselves are by the text."""

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            sums, sizes, at, times, cuts = [], [], [], [], [0]
            for text in raw_texts(batch.column(0)):
                found = words(text)
                all_of = features(found, ngram, buckets, known)
                where, count = np.unique(all_of, return_counts=True)
                sums.append(len(found))
                sizes.append(len(all_of))
                at.append(where)
                times.append(count)
                cuts.append(cuts[-1] + len(where))
            if sums:
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(x), pa.int32())) for x in (at, times)]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), long_array(sums), long_array(sizes), *lists], names=["digest", "n", "n_words", "n_features", "at", "times"])

    same = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    return same.select("text", F.sha2("text", 256).alias("digest"), "n").mapInArrow(run, "digest string, n long, n_words long, n_features long, at array<int>, times array<int>")


def totals(of: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows that classes stand for, added up by bucket in each task first; a row a bucket comes here."""
    each = of.select("n", F.inline(F.arrays_zip("at", "times")))
    rows = each.groupBy("at").agg(F.sum(F.col("n") * F.col("times")).alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares of the target's and the source's features."""
    s, t = source.astype(float), target.astype(float)
    buckets = len(s)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(of: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, n_words, n_features, weight): the floored mean of gains over a class's features; without any, 0."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(2).to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(size)), batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            total = np.zeros(len(size), np.int64)
            np.add.at(total, own, gain[batch.column(3).flatten().to_numpy(zero_copy_only=False)] * batch.column(4).flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), long_array(total // np.maximum(size, 1))], names=["digest", "n_words", "n_features", "weight"])

    return of.select("digest", "n_words", "n_features", "at", "times").mapInArrow(run, "digest string, n_words long, n_features long, weight long")


def gumbel(id_col: str | Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel number of an id; a null id counts as an empty one."""
    of = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(of, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with rank, 1, 2, 3 ... in the order given. Rows are dealt out by ranges and sorted there, and a rank is a row's place in its
    part after those of the parts before: nothing meets in one task, and equal rows are dealt out by their place in the input."""
    spark = rows.sparkSession
    placed = written(rows.withColumn("_row", F.monotonically_increasing_id()), f"{name}-rows")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by = [*order, F.col("_row")]
    dealt = placed.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), f"{name}-ranges")
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a part
    starts, before = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(part, 0)
    start = F.element_at(F.array(*map(F.lit, starts)).cast("array<long>"), F.col("_part") + 1) if starts else F.lit(0)
    return dealt.withColumn("rank", F.col("_at") + 1 + start).drop("_row", "_part", "_at")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank): a row for each of docs. score is the weight and the id's Gumbel number; of the N rows of
    least_words words and more the floor(percent * N / 100) of the highest scores are drawn, ties to the smaller id (null last), and
    rank counts them from 1; it is null for the others.

    A null text is an empty one, which has weight 0; repeated rows are rows of their own, with ranks of their own; an empty target
    leaves the smoothing alone to it; empty docs give no rows. Other columns of docs are not read."""
    of = written(classes(docs, text_col, ngram, buckets), "importance-classes")
    gain = gains(totals(of, buckets), totals(classes(target, target_col, ngram, buckets), buckets))
    weighed = weights(of, gain)
    keys = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("digest"))
    scored = keys.join(weighed, "digest").select("id", "n_words", "n_features", "weight", (F.col("weight") + gumbel("id", seed)).alias("score"))
    rows = written(scored, "importance-scores")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    top = ranked(able.drop("n_words"), [F.col("score").desc(), F.col("id").asc_nulls_last()], "importance")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    out = ["id", "n_features", "weight", "score"]
    return top.select(*out, rank.alias("rank")).unionByName(rows.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, weight and score towards the benchmark's texts, and its rank if it is drawn. Null texts are empty,
    repeated rows are drawn apart, empty tables give no rows (see resampled)."""
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: crc32 of a word is a fold over its UTF-8 bytes with the table of the polynomial 0xEDB88320, which is made by its rule.
OP11_SQL = r"""
with recursive bits(i, k, c) as (
    select i, 0, i::ubigint from range(256) r(i) union all
    select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
dw as (select doc_id, w, count(*) as n from (select doc_id, unnest(words) as w from d) group by all),
bw as (select w, count(*) as n from (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark) group by w),
vocabulary as (select distinct w, hex(encode(w)) as h from (select w from dw union all select w from bw)),
hashed as (
    select w, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, 2 * k::int + 1, 2))::ubigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint) % 10000 as bucket
    from vocabulary, crc),
s as (select bucket, sum(n)::double as s from dw join hashed using (w) group by bucket),
t as (select bucket, sum(n)::double as t from bw join hashed using (w) group by bucket),
gain as (
    select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((select coalesce(sum(s), 0) from s) + 10000) / ((coalesce(s, 0) + 1) * ((select coalesce(sum(t), 0) from t) + 10000))))::bigint as g
    from s full join t using (bucket)),
weighed as (select doc_id, sum(n)::bigint as n_features, sum(n * g)::bigint as total from dw join hashed using (w) join gain using (bucket) group by doc_id),
scored as (
    select d.doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(floor(total::double / n_features), 0)::bigint as weight,
        floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::ubigint::double + 0.5) / 4294967296.0)))::bigint as noise
    from d left join weighed using (doc_id)),
placed as (
    select *, weight + noise as score, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by weight + noise desc, doc_id) end as place,
        (10 * count(*) filter (n_features >= 20) over ()) // 100 as drawn from scored)
select doc_id, n_features, weight, score, case when place <= drawn then place end as rank from placed
"""
