"""Near-duplicate embeddings by an inverted multi-index.

A vector, scaled to length 1, is cut into two halves, each with a codebook of its own; a pair of codewords is a cell of their
product grid. A vector is filed in the cell of its halves' nearest codewords. It is then held against the cells that a
multi-sequence traversal of its two lists of codewords reaches, nearest first: cells are ordered by the sum of how near (squared)
anything filed under each codeword can be to each half, which half-spaces between codewords bound from below. The traversal stops
at the squared distance that the cosine stands for, so at a target recall of 1 no partner can be in a cell beyond it; a lower
target stops earlier, by a sample. Of two cells that reach each other one side looks into the other, so pairs meet once. What
meets is verified by its cosine in double precision."""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_array, table, written
from .components import components

LINKED = 0.98
TARGET_RECALL = 1.0
#: Classes of a label in a cell, on average, that the codebooks' size aims at, and codewords of a half at most.
CELL, MOST_WORDS = 1024, 256
#: Vectors (those of the smallest hashes) that the codebooks are fitted on, and rounds of k-means.
FIT, ROUNDS = 8192, 12
#: Rows of a cell that one task holds against as many others; larger cells are dealt out as pairs of tiles this size.
TILE = 1024
#: Cosines this near the threshold are computed again, one by one.
_CLOSE = 1e-9

Codebooks = dict[int, tuple[np.ndarray, np.ndarray]]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, of lists of one length without nulls, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(x).max(1, initial=0, keepdims=True))
    return np.ldexp(x, -exponent)


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def marked(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vec, dim, key): rows with a digest of the vector's components as key; null where the row links with nothing."""
    kinds = dict(rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).dtypes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = []
            for known, x in zip(batch.column(1).is_valid().to_pylist(), batch.column(2), strict=True):
                if not known or not x.is_valid or x.values.null_count:
                    keys.append(None)
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(float) + 0.0  # no zero is negative
                keys.append(blake2b(v.tobytes(), digest_size=16).digest() if np.isfinite(v).all() and v.any() else None)
            lengths = batch.column(2).value_lengths()
            yield pa.RecordBatch.from_arrays([*batch.columns, lengths.cast(pa.int32()), pa.array(keys, pa.binary())], names=["id", "label", "vec", "dim", "key"])

    read = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    return read.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, vec {kinds['vec']}, dim int, key binary")


# ---------------------------------------------------------------- the index


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """At most k codewords by k-means."""
    rng = np.random.default_rng(11)
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = distances(x, words).argmin(1)
        count = np.bincount(own, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], words)
    return words


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1), 0)


def reach(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of halves x each one's nearest codeword, and for every codeword a squared distance that nothing filed under it is nearer than:
    that to the half-spaces between it and other codewords."""
    d = distances(x, words)
    apart = np.sqrt(distances(words, words))
    np.fill_diagonal(apart, 0)
    with np.errstate(divide="ignore"):
        scale = np.where(apart > 1e-6, 1 / (2 * apart), 0)
    out = np.zeros_like(d)
    for k in range(len(words)):
        np.maximum(out, (d - d[:, k : k + 1]) * scale[:, k], out=out)
    return d.argmin(1), out * out


def multi_sequence(first: np.ndarray, second: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j): for each row of two lists the cells that the traversal has visited when the least sum left is over stop: down each
    row of the grid of the sorted lists it goes to where the sum is stop."""
    a, b = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
    x, y = np.take_along_axis(first, a, 1), np.take_along_axis(second, b, 1)
    deep = np.stack([(y <= (stop - x[:, k])[:, None]).sum(1) for k in range(x.shape[1])], 1)
    row, rank = np.nonzero(deep)
    times = deep[row, rank]
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    row, rank = np.repeat(row, times), np.repeat(rank, times)
    return row, a[row, rank], b[row, at]


def squared_radius(linked: float) -> float:
    return 2 - 2 * linked + _CLOSE


def fitted(x: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    half = x.shape[1] // 2
    return codebook(x[:, :half], side), codebook(x[:, half:], side)


def stop_for(books: Codebooks, sample: dict[int, np.ndarray], linked: float, target: float) -> float:
    """Where the traversal stops. For a target under 1: where that share of made-up partners of the sample, at the largest distance
    in random directions, has been reached."""
    most = squared_radius(linked)
    if target >= 1 or not sample:
        return most
    rng, seen = np.random.default_rng(12), []
    for dim, x in sample.items():
        step = rng.normal(size=x.shape)
        other = units(x + step / np.sqrt((step * step).sum(1, keepdims=True)) * math.sqrt(most))
        total = 0
        for words, own, its in zip(books[dim], (x[:, : dim // 2], x[:, dim // 2 :]), (other[:, : dim // 2], other[:, dim // 2 :]), strict=True):
            total = total + reach(own, words)[1][np.arange(len(x)), reach(its, words)[0]]
        seen.append(total)
    return min(most, float(np.quantile(np.concatenate(seen), target)))


def _filing(books: Codebooks, stop: float):
    """classes (cls, label, dim, vec) to (cls, label, dim, cell, probe): each in its own cell, and as a probe in those with larger
    numbers that it reaches."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = units(matrix(batch.column(3).take(pa.array(rows))))
                words = books.get(dim) or (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))
                step = max(1, (1 << 22) // (len(words[0]) * len(words[1])))
                for k in range(0, len(rows), step):
                    (i, near), (j, far) = reach(x[k : k + step, : dim // 2], words[0]), reach(x[k : k + step, dim // 2 :], words[1])
                    home = i * MOST_WORDS + j
                    row, a, b = multi_sequence(near, far, stop)
                    cell = a * MOST_WORDS + b
                    on = cell > home[row]
                    row, cell = np.concatenate([np.arange(len(home)), row[on]]), np.concatenate([home, cell[on]])
                    own = pa.array(rows[k + row])
                    probe = np.arange(len(row)) >= len(home)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(probe)], names=["cls", "label", "dim", "cell", "probe"])

    return run


# ---------------------------------------------------------------- verification


def within(a: np.ndarray, b: np.ndarray, linked: float) -> np.ndarray:
    """Which rows of a and b have a cosine of linked and more."""
    x, y = units(a), units(b)
    cosine = x @ y.T
    for i, j in zip(*np.nonzero(np.abs(cosine - linked) < _CLOSE), strict=True):
        u, v = scaled(a[i : i + 1])[0], scaled(b[j : j + 1])[0]
        cosine[i, j] = math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v))
    return cosine >= linked


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node reachable of each of n nodes by edges (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _comparing(linked: float):
    """A group's rows (a, b, kind, probe, own, cls, n, vec) to counts (a, null, n) and links (a, b, null)."""

    def run(group: pa.Table) -> pa.Table:
        a, b, kind = (group.column(c)[0].as_py() for c in ("a", "b", "kind"))
        probe, own = group.column("probe").to_numpy(), group.column("own").to_numpy()
        cls, n, x = group.column("cls").to_numpy(), group.column("n").to_numpy(), matrix(group.column("vec").combine_chunks())
        home, probes = np.flatnonzero(~probe & (own == a)), np.flatnonzero(probe)
        parts = [(home, probes)]
        if kind == 0:
            parts.append((home, home if a == b else np.flatnonzero(~probe & (own == b))))
        add, i, j = np.zeros(len(cls), np.int64), [], []
        for left, right in parts:
            if not len(left) or not len(right):
                continue
            hit = within(x[left], x[right], linked)
            if left is right:
                hit = np.triu(hit, 1)
            add[left] += hit @ n[right]
            add[right] += hit.T @ n[left]
            p, q = np.nonzero(hit)
            i.append(left[p])
            j.append(right[q])
        i, j = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (i, j))
        root, some = roots(len(cls), i, j), np.flatnonzero(add)
        joined = np.flatnonzero(root != np.arange(len(cls)))
        first, other = np.concatenate([cls[some], cls[joined]]), [*([None] * len(some)), *cls[root[joined]].tolist()]
        return pa.table([long_array(first), pa.array(other, pa.int64()), pa.array([*add[some].tolist(), *([None] * len(joined))], pa.int64())], names=["a", "b", "n"])

    return run


def _grouped(filed: DataFrame, classes: DataFrame) -> DataFrame:
    """The filed rows with their vectors, once in each group that they are compared in: (label, dim, cell) and tiles a, b. kind 0: the
    cell's own rows (a, b) and, if all is one tile, its probes; kind 1: own rows a with probes b."""
    sizes = filed.groupBy("label", "dim", "cell").agg(F.count_if(~F.col("probe")).alias("h"), F.count_if("probe").alias("p")).where("h > 0 and h + p > 1")
    tiled = sizes.select("label", "dim", "cell", F.ceil(F.col("h") / TILE).cast("int").alias("hs"), F.ceil(F.col("p") / TILE).cast("int").alias("ps"))
    rows = filed.join(tiled, ["label", "dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.when(F.col("probe"), F.col("ps")).otherwise(F.col("hs"))).cast("int"))
    zero, one = F.lit(0), F.lit(1)

    def group(a, b, kind):
        return F.struct(a.alias("a"), b.alias("b"), kind.alias("kind"))

    def to(n):
        return F.slice(F.sequence(zero, F.greatest(n - 1, zero)), 1, n)

    single = (F.col("hs") == 1) & (F.col("ps") <= 1)
    homes = F.transform(to(F.col("hs")), lambda o: group(F.least("own", o), F.greatest("own", o), zero))
    meets = F.transform(to(F.col("ps")), lambda o: group(F.col("own"), o, one))
    probes = F.transform(to(F.col("hs")), lambda o: group(o, F.col("own"), one))
    groups = F.when(single, F.array(group(zero, zero, zero))).when(F.col("probe"), probes).otherwise(F.concat(homes, meets))
    dealt = rows.select("label", "dim", "cell", "cls", "probe", "own", F.explode(groups).alias("g")).select("label", "dim", "cell", "g.*", "probe", "own", "cls")
    return dealt.join(classes.select("cls", "n", "vec"), "cls")


def clusters(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", linked: float = LINKED, target_recall: float = TARGET_RECALL
) -> DataFrame:
    """(id, n_links, component_id, kept): a row for each of rows. Rows of one label and of one length link at a cosine of linked and
    more; n_links counts the other rows so linked, component_id is the smallest id reachable.

    Rows of equal vectors are one class, which counts as often as it has rows, so copies are never expanded. A row whose label or
    vector is null, or whose vector is empty, zero or has components that are null or not finite, links with nothing and is a component
    of its own. Repeated ids are rows of their own. Null ids are in a component as others are, but no component's smallest id; kept is
    false for them. An empty table gives no rows; other columns are not read."""
    spark = rows.sparkSession
    every = written(marked(rows, id_col, vec_col, label_col), "multiindex-rows")
    some = every.where(F.col("key").isNotNull())
    same = some.groupBy("label", "key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec"))
    classes = written(same.withColumn("cls", F.monotonically_increasing_id()), "multiindex-classes")

    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    side = min(MOST_WORDS, max(1, math.ceil(math.sqrt(most / CELL))))
    sample: dict[int, np.ndarray] = {}
    if most:
        drawn = classes.orderBy(F.xxhash64("key"), "cls").limit(FIT).select("dim", "vec").toArrow()  # FIT rows
        dims = drawn.column("dim").to_numpy()
        sample = {d: units(matrix(drawn.column("vec").combine_chunks().take(pa.array(np.flatnonzero(dims == d))))) for d in np.unique(dims).tolist()}
    books = {d: fitted(x, side) for d, x in sample.items()}
    stop = stop_for(books, sample, linked, target_recall)

    kind = dict(classes.dtypes)["label"]
    filed = written(classes.select("cls", "label", "dim", "vec").mapInArrow(_filing(books, stop), f"cls long, label {kind}, dim int, cell int, probe boolean"), "multiindex-filed")
    grouped = _grouped(filed, classes).groupBy("label", "dim", "cell", "a", "b", "kind")
    found = written(grouped.applyInArrow(_comparing(linked), "a long, b long, n long"), "multiindex-links")
    counts = found.where(F.col("n").isNotNull()).groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    joined = components(found.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "cls")
    known = classes.drop("vec", "dim").join(counts, "cls", "left").join(joined, "cls", "left")
    known = written(known.select("label", "key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")), "multiindex-known")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of = known.join(smallest, "root").select("label", "key", "n_links", "component_id")
    linking = some.drop("vec", "dim").join(of, ["label", "key"]).select("id", "n_links", "component_id")
    alone = every.where(F.col("key").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linking.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op12_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component among those of its label (see clusters, which defines nulls, zeros, repeats and an empty table)."""
    return clusters(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id").withColumn("component_id", F.col("component_id").cast("long"))


OP12_SQL = """
with recursive v as (
    select vec_id, label, embedding::double[] as x from embeddings
    where label is not null and embedding is not null and list_count(embedding) = len(embedding)
        and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select vec_id, label, x, sqrt(list_inner_product(x, x)) as size from v),
links as (
    select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id
    where list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.98),
reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
least as (select a, min(b) as b from reached group by a),
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(b, vec_id)) as component_id, vec_id <= coalesce(b, vec_id) as kept
from embeddings left join least on least.a = vec_id left join counts on counts.a = vec_id
"""
