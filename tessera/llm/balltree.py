"""Hard negatives for contrastive training by ball-tree branch-and-bound.

Rows are dealt into parts of bounded size, each with a tree of balls for every label. A ball (centre, radius) bounds the inner
products of an anchor with anything in it from both sides: q.c - |q| r and q.c + |q| r. A search skips a ball whose bounds lie outside
the scores it wants, or strictly beneath the kth best that it has; what is equal to the kth is looked at, as ties go by id. Parts
return their k best, and the best of those are the whole table's. Positives come first; the scores of each one then are the window
in which its negatives are sought, among the other labels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import long_array, table, written

#: Components are floor(SCALE * x); positives of an anchor and negatives of a positive; the window is of shares LOW / OF to 1 of the
#: positive's score.
SCALE, POSITIVES, NEGATIVES, LOW, OF = 256, 5, 5, 80, 100
#: Rows of a part and of a leaf, and searches that a task holds against a part at once.
PART, LEAF, BLOCK = 8192, 64, 2048

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

# ---------------------------------------------------------------- the tree


class Tree:
    """Balls over rows of whole numbers. order: the rows, so that a node's are one slice; nodes: (start, end, left, right), -1 at leaves."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        todo = [(0, len(x), -1, False)] if len(x) else []
        while todo:
            start, end, parent, right = todo.pop()
            rows = self.order[start:end]
            centre = x[rows].mean(0)
            away = np.sqrt(((x[rows] - centre) ** 2).sum(1))
            at = len(self.nodes)
            self.nodes.append((start, end, -1, -1))
            self.centre.append(centre)
            self.radius.append(float(away.max()))
            if parent >= 0:
                s, e, left, other = self.nodes[parent]
                self.nodes[parent] = (s, e, left, at) if right else (s, e, at, other)
            if end - start > leaf and away.max() > 0:
                # Between the row that is furthest from the centre and the one furthest from that, rows go to the nearer half.
                a = x[rows[away.argmax()]]
                b = x[rows[((x[rows] - a) ** 2).sum(1).argmax()]]
                half = (end - start) // 2
                self.order[start:end] = rows[np.argpartition(x[rows] @ (a - b), half)]
                todo += [(start, start + half, at, False), (start + half, end, at, True)]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; beyond 64 bits they stay at the ends of the range."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= 2.0**53:
        whole = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
        return np.clip(whole, _LEAST, _MOST).astype(np.int64)
    return (q @ x.T).astype(np.int64)


class Search:
    """The k best rows of each of some searches: rows q with windows of scores [low, high]. own: each search's row, which it leaves out."""

    def __init__(self, q: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        # Searches of one anchor with several windows share its products.
        _, first, self.anchor = np.unique(own, return_index=True, return_inverse=True)
        self.q, self.own, self.low, self.high, self.k = q[first], own, low, high, k
        self.size = np.sqrt((self.q * self.q).sum(1))
        self.score = np.full((len(own), k), _LEAST)
        self.id = np.full((len(own), k), _MOST)
        self.held = np.zeros((len(own), k), bool)
        self.leaves = 0

    def within(self, tree: Tree, node: int, asked: np.ndarray) -> tuple[np.ndarray, float]:
        """Which of the searches asked need a node, and the largest product with its centre among them."""
        at = self.anchor[asked]
        middle = (self.q @ tree.centre[node])[at]
        spread = self.size[at] * tree.radius[node]
        spread += 1e-6 + 1e-9 * (spread + np.abs(middle))  # for rounding
        full = self.held[asked, -1]
        on = (middle + spread >= self.low[asked]) & (middle - spread <= self.high[asked]) & ~(full & (middle + spread < self.score[asked, -1]))
        return asked[on], float(middle[on].max(initial=-math.inf))

    def run(self, tree: Tree, x: np.ndarray, ids: np.ndarray, row: np.ndarray, asked: np.ndarray) -> None:
        todo = [(0, asked)] if len(tree.nodes) else []
        while todo:
            node, asked = todo.pop()
            asked, _ = self.within(tree, node, asked)  # again: the kth may have risen since it was put off
            if not len(asked):
                continue
            start, end, left, right = tree.nodes[node]
            if left < 0:
                at = tree.order[start:end]
                self.take(x[at], ids[at], row[at], asked)
                continue
            # The child with the nearer centre comes last, as the last is looked at first.
            sides = [(child, *self.within(tree, child, asked)) for child in (left, right)]
            todo += [(child, some) for child, some, _ in sorted(sides, key=lambda side: side[2]) if len(some)]

    def take(self, x: np.ndarray, ids: np.ndarray, row: np.ndarray, asked: np.ndarray) -> None:
        self.leaves += len(asked)
        anchors, back = np.unique(self.anchor[asked], return_inverse=True)
        score = products(self.q[anchors], x)[back]
        fits = (score >= self.low[asked, None]) & (score <= self.high[asked, None]) & (row[None, :] != self.own[asked, None])
        fits &= ~self.held[asked, -1:] | (score >= self.score[asked, -1:])
        some = np.flatnonzero(fits.any(1))
        if not len(some):
            return
        at, fits = asked[some], fits[some]
        held = np.concatenate([self.held[at], fits], 1)
        score = np.concatenate([self.score[at], score[some]], 1)
        ids = np.concatenate([self.id[at], np.broadcast_to(ids, fits.shape)], 1)
        best = np.lexsort((ids, ~score, ~held), axis=1)[:, : self.k]  # ~score falls as score grows, without overflow
        self.held[at], self.score[at], self.id[at] = (np.take_along_axis(v, best, 1) for v in (held, score, ids))


# ---------------------------------------------------------------- over Spark


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def prepared(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE, label: Column | None = None) -> DataFrame:
    """(id, label, dim, x, row): the rows that take part, x their components as whole numbers, row a number of each row's own."""
    read = rows.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    some = read.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    # Not null, not NaN, under infinity.
    some = some.where(F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(math.inf), F.lit(False))))
    whole = F.transform("x", lambda v: F.rint(v * scale) - F.when(F.rint(v * scale) > v * scale, 1.0).otherwise(0.0))  # floor, as a double
    return written(some.select("id", "label", F.size("x").alias("dim"), whole.alias("x"), F.monotonically_increasing_id().alias("row")), "balltree-rows")


def search(rows: DataFrame, queries: DataFrame, k: int, same_label: bool, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(query, place, id, score): the k best of rows (as prepared) for each of queries (query, own, label, dim, x, low, high) by the
    exact inner product, then the smaller id, of those of the query's label or of another, with scores from low to high, but for the
    row own. Rows meet queries of their length, part by block: each pair is a group of at most part rows and block queries or so."""
    parts, blocks = (max(1, math.ceil(df.count() / size)) for df, size in ((rows, part), (queries, block)))
    left = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("own", "high"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def run(them: pa.Table, asked: pa.Table) -> pa.Table:
        found = ([], [], [])
        if them.num_rows and asked.num_rows:
            x, ids, row, labels = _matrix(them.column("x")), *(them.column(c).to_numpy() for c in ("id", "row", "label"))
            number, own, of, low, high = (asked.column(c).to_numpy() for c in ("query", "own", "label", "low", "high"))
            state = Search(_matrix(asked.column("x")), own, low, high, k)
            for label in np.unique(labels):
                at = np.flatnonzero(labels == label)
                wanted = np.flatnonzero((of == label) == same_label)
                if len(wanted):
                    state.run(Tree(x[at]), x[at], ids[at], row[at], wanted)
            which, place = np.nonzero(state.held)
            found = (number[which], state.id[which, place], state.score[which, place])
        return pa.table([long_array(c) for c in found], names=["query", "id", "score"])

    groups = ["part", "block", "dim"]
    best = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(run, "query long, id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return best.withColumn("place", place).where(F.col("place") <= k)


def mined(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, of: int = OF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (as prepared): for the rows where anchors
    holds, their best other rows of the same label as positives, and for each the best rows of other labels whose scores are between
    low / of of the positive's and the positive's own. Fewer are returned where there are fewer; a negative window is empty.

    Rows of equal ids are rows of their own, as anchors and as others; rows meet those of their vector's length. Scores beyond 64 bits
    stay at the ends of the range."""
    asked = rows.where(anchors)
    first = asked.select(F.col("row").alias("query"), F.col("row").alias("own"), "label", "dim", "x", F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"))
    near = search(rows, first, positives, True)
    ours = written(near.join(asked.select(F.col("row").alias("query"), F.col("id").alias("anchor_id")), "query").select("query", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "balltree-positives")
    # ceil(low * s / of) without a product beyond 64 bits: s less the floor of its share of - low.
    common = math.gcd(of, low)
    share, whole = (of - low) // common, of // common
    least = F.col("positive_score") - F.floor(F.col("positive_score").cast("decimal(20,0)") * share / whole).cast("long")
    windows = ours.select("query", "positive_score").distinct().withColumn("low", least).where("low <= positive_score")
    windows = written(windows.withColumn("window", F.monotonically_increasing_id()), "balltree-windows")
    second = windows.join(asked.select(F.col("row").alias("query"), "label", "dim", "x"), "query")
    second = written(second.select(F.col("window").alias("query"), F.col("query").alias("own"), "label", "dim", "x", "low", F.col("positive_score").alias("high")), "balltree-searches")
    hard = search(rows, second, negatives, False).select(F.col("query").alias("window"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = hard.join(windows.select("window", "query", "positive_score"), "window").join(ours, ["query", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100; labels of those divisible by 7 are moved on by one first. Rows with a
    null id, label or vector, or a component that is null or not finite, take no part; repeated rows are rows of their own; an empty
    table gives no rows."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(prepared(table(spark, sf_dir, "embeddings"), label=moved), F.col("id") % 100 == 0)


OP13_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
    where label is not null and embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
s as (
    select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
    select anchor_id, other as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other)::int as rank, other as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other) <= 5
"""
