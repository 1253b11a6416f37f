"""Rasters as tiles, and the kernels over tiles, patches and point sets.

A tile is a row (image_id, row_off, col_off, h, w, dtype, px): px is the row-major payload. Every kernel works on one tile, patch,
block or bounded set of points, so a task's memory doesn't depend on the raster's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.sources.shared import written

TILE = "image_id string, row_off int, col_off int, h int, w int, dtype string, px binary"


def tiles_of(spark: SparkSession, image_id: str, image: np.ndarray, size: int = 512) -> DataFrame:
    """An array as tiles; for fixtures and small products."""
    rows = [(image_id, y, x, *image[y : y + size, x : x + size].shape, image.dtype.str, image[y : y + size, x : x + size].tobytes()) for y in range(0, image.shape[0], size) for x in range(0, image.shape[1], size)]
    return spark.createDataFrame(rows, TILE)


def pixels_of(h: int, w: int, dtype: str, px: bytes) -> np.ndarray:
    return np.frombuffer(px, dtype).reshape(h, w)


def pack_rows(df: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """Long rows (key, row, col, v) as one patch of float64 per key: bounded by height x width values each."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((height, width))
        a[pdf["row"].to_numpy() % height, pdf["col"].to_numpy() % width] = pdf["v"].to_numpy()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "h": [height], "w": [width], "dtype": ["<f8"], "px": [a.tobytes()]})

    return df.select(key, "row", "col", "v").groupBy(key).applyInPandas(pack, f"{key} {df.select(key).dtypes[0][1]}, h int, w int, dtype string, px binary")


def each_patch(patches: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """patches with px (and dtype) replaced by what the kernel makes of each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [np.ascontiguousarray(kernel(pixels_of(*x))) for x in zip(pdf["h"], pdf["w"], pdf["dtype"], pdf["px"], strict=True)]
            yield pdf.assign(h=[o.shape[0] for o in out], w=[o.shape[1] for o in out], dtype=[o.dtype.str for o in out], px=[o.tobytes() for o in out])

    return patches.mapInPandas(run, patches.schema)


def equalised(patches: DataFrame, clip: float = 2.0, grid: int = 8) -> DataFrame:
    return each_patch(patches, lambda a: K.clahe(K.stretched(a.astype(float)) if a.dtype != np.uint8 else a, clip, grid))


def sharpened(patches: DataFrame) -> DataFrame:
    return each_patch(patches, lambda a: K.unsharp(a.astype(float)))


def structural_maps(patches: DataFrame, method: str = "phase_congruency") -> DataFrame:
    K.structural(np.zeros((2, 2)), method)  # an unknown method fails here, not in a task
    return each_patch(patches, lambda a: K.structural(a.astype(float), method))


def long_form(patches: DataFrame, key: str) -> DataFrame:
    """(key, row, col, v) of patches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, h, w, dtype, px in zip(pdf[key], pdf["h"], pdf["w"], pdf["dtype"], pdf["px"], strict=True):
                yy, xx = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({key: k, "row": yy.astype(np.int32), "col": xx.astype(np.int32), "v": pixels_of(h, w, dtype, px).ravel().astype(float)})

    return patches.mapInPandas(run, f"{key} {patches.select(key).dtypes[0][1]}, row int, col int, v double")


def _pairs(pairs: DataFrame, key: str, schema: str, kernel: Callable[[np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """kernel over rows with two patches (a_*, b_*); its rows follow the key."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rows += [(getattr(r, key), *x) for x in kernel(pixels_of(r.a_h, r.a_w, r.a_dtype, r.a_px), pixels_of(r.b_h, r.b_w, r.b_dtype, r.b_px))]
            yield pd.DataFrame(rows, columns=[key, *names])

    return pairs.mapInPandas(run, f"{key} {pairs.select(key).dtypes[0][1]}, {schema}")


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    side = lambda df, p: df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in ("h", "w", "dtype", "px")))
    return side(a, "a").join(side(b, "b"), key)


def phase_shift(pairs: DataFrame, key: str, prepare: Callable[[np.ndarray], np.ndarray] = lambda a: a, least: float = 0.0) -> DataFrame:
    """(key, dx, dy, response) of each pair of patches, as prepared; none of a pair of which one has data in under the share least."""
    def run(a: np.ndarray, b: np.ndarray) -> list[tuple]:
        return [K.phase_correlation(prepare(a), prepare(b))] if min((a > 0).mean(), (b > 0).mean()) >= least else []

    return _pairs(pairs, key, "dx double, dy double, response double", run)


def subpixel(pairs: DataFrame, key: str, threshold: float = 0.45) -> DataFrame:
    """(key, ox, oy, score) of the pairs that could be refined."""
    return _pairs(pairs, key, "ox double, oy double, score double", lambda a, b: [x] if (x := K.refine(a, b, threshold)) else [])


def matched(pairs: DataFrame, key: str, matcher: Callable = K.grid_matcher) -> DataFrame:
    """(key, sx, sy, rx, ry, score): what a matcher (array, array) -> (points, points, confidence) finds; one that fails on a
    pair finds nothing there."""
    names = ["sx", "sy", "rx", "ry", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False):
                try:
                    p, q, c = matcher(pixels_of(r.a_h, r.a_w, r.a_dtype, r.a_px).astype(float), pixels_of(r.b_h, r.b_w, r.b_dtype, r.b_px).astype(float))
                except (ValueError, FloatingPointError, np.linalg.LinAlgError):
                    p = q = c = ()
                found.append(np.column_stack([np.asarray(p, float).reshape(-1, 2), np.asarray(q, float).reshape(-1, 2), np.asarray(c, float)]))
            rows = pd.DataFrame(np.concatenate([*found, np.zeros((0, 5))]), columns=names)
            rows.insert(0, key, pdf[key].repeat([len(x) for x in found]).reset_index(drop=True))
            yield rows

    return pairs.mapInPandas(run, f"{key} {pairs.select(key).dtypes[0][1]}, {', '.join(f'{c} double' for c in names)}")


def found_circles(patches: DataFrame, key: str, smallest: int = 15, largest: int = 200, least_votes: int = 25) -> DataFrame:
    """(key, cx, cy, r) of the circles in each patch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *map(float, c)) for k, h, w, t, px in zip(pdf[key], pdf["h"], pdf["w"], pdf["dtype"], pdf["px"], strict=True) for c in K.circles(pixels_of(h, w, t, px), smallest, largest, least_votes)]
            yield pd.DataFrame(rows, columns=[key, "cx", "cy", "r"])

    return patches.mapInPandas(run, f"{key} {patches.select(key).dtypes[0][1]}, cx double, cy double, r double")


# ---------------------------------------------------------------- point sets


#: Rows of a group in one batch from which on they are cut down to their hull's corners, and rows that the last step looks at together.
_MANY, _TOGETHER = 32, 1 << 16


def dealt(df: DataFrame, key: str, rows: int = 128) -> DataFrame:
    """df in partitions of about rows rows, so that work which is far larger than the rows that it starts from is shared out; Spark
    cuts small tables by their bytes alone."""
    n = df.count()
    return df.repartition(max(-(-n // rows), min(max(n, 1), df.sparkSession.sparkContext.defaultParallelism)), key)


def hull_shares(points: DataFrame, x: str, y: str, area: float, by: Sequence[str]) -> DataFrame:
    """(by, share) of each group's hull in an area.

    A hull's corners are corners of any part's hull: what a batch has of a group is cut down to its corners before it moves, so a
    large group meets in one task as a few corners of each batch. Groups then come sorted, and many are looked at together; one that
    goes on for long is cut down again as it comes."""
    keys = list(by)
    places = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kinds = "".join(f"{k} {t}, " for k, t in places.select(*keys).dtypes)

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _cut_down(pa.table(batch.columns, names=batch.schema.names), len(keys)).combine_chunks().to_batches()

    def shares(t: pa.Table) -> Iterator[pa.RecordBatch]:
        order, ends = _groups(t, len(keys))
        xy = np.column_stack([t.column(len(keys) + k).to_numpy() for k in (0, 1)])[order]
        found = [K.hull_share(xy[a:b], area) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        first = t.select(range(len(keys))).take(pa.array(order[ends[:-1]])).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in first.columns), pa.array(found, pa.float64())], names=[*keys, "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                held.append(pa.table(batch.columns, names=batch.schema.names))  # one schema, whatever can't be null
            if sum(t.num_rows for t in held) < _TOGETHER:
                continue
            whole = pa.concat_tables(held)
            order, ends = _groups(whole, len(keys))
            last = next(k for k in range(len(ends) - 1) if (order[ends[k] : ends[k + 1]] == whole.num_rows - 1).any())
            own = np.sort(order[ends[last] : ends[last + 1]])  # the last group may go on
            rest = np.setdiff1d(np.arange(whole.num_rows), own, assume_unique=True)
            if len(rest):
                yield from shares(whole.take(pa.array(rest)))
            held = [_cut_down(whole.take(pa.array(own)), len(keys))]
        if held:
            yield from shares(pa.concat_tables(held))

    cut = places.mapInArrow(corners, f"{kinds}x double, y double")
    met = cut.repartition(*keys).sortWithinPartitions(*keys) if keys else cut.coalesce(1)
    return met.mapInArrow(run, f"{kinds}share double")


def _groups(t: pa.Table, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): rows of t by its first n_keys columns, and where each group starts and the last ends. Nulls are a key as others."""
    code = np.zeros(t.num_rows, np.int64)
    for k in range(n_keys):
        column = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        pair = code * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False)
        code = np.unique(pair, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0, [True]]))


def _cut_down(t: pa.Table, n_keys: int) -> pa.Table:
    """t (keys, x, y) with each group of over _MANY rows cut down to its hull's corners."""
    order, ends = _groups(t, n_keys)
    size = np.diff(ends)
    if not (size > _MANY).any():
        return t
    xy = np.column_stack([t.column(n_keys + k).to_numpy() for k in (0, 1)])[order]
    at, out = [order[np.repeat(size <= _MANY, size)]], [xy[np.repeat(size <= _MANY, size)]]
    for k in np.flatnonzero(size > _MANY):
        ring = K.hull_ring(xy[ends[k] : ends[k + 1]])
        at.append(np.full(len(ring), order[ends[k]]))
        out.append(ring)
    kept, place = t.take(pa.array(np.concatenate(at))), np.concatenate(out)
    return pa.table([*(kept.column(k) for k in range(n_keys)), pa.array(place[:, 0]), pa.array(place[:, 1])], names=t.column_names)


def robust_inliers(points: DataFrame, by: str, threshold: float, affine: bool = False, least: int = 4, most: int = 200_000) -> DataFrame:
    """The points of each group (a tile's matches) that one similarity or affine explains; groups under least points have none. Groups
    are counted first; those of over most points, which no task should hold, go by robust_by_rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pdf.iloc[:0]
        _, ok = K.ransac(pdf[["sx", "sy"]].to_numpy(), pdf[["rx", "ry"]].to_numpy(), threshold, affine)
        return pdf[ok]

    large = [r[0] for r in points.groupBy(by).count().where(F.col("count") > most).select(by).limit(1).collect()]
    if not large:
        return points.groupBy(by).applyInPandas(run, points.schema)
    groups = written(points.groupBy(by).agg(F.count("*").alias("__n")), "groups")
    near = lambda cond: points.join(groups.where(cond).select(F.col(by).alias("__by")), F.col(by).eqNullSafe(F.col("__by")), "left_semi")
    small = near(F.col("__n") <= most).groupBy(by).applyInPandas(run, points.schema)
    return small.unionByName(robust_by_rows(near(F.col("__n") > most), by, threshold, affine))


def _hypotheses(held: np.ndarray, count: int, affine: bool, seed: int) -> np.ndarray:
    """Models (n, 6) through random rows (sx, sy, rx, ry); degenerate picks are drawn again."""
    need, rng, models = 3 if affine else 2, np.random.default_rng(seed), []
    for _ in range(20 * count if len(held) >= need else 0):
        if len(models) == count:
            break
        pick = held[rng.choice(len(held), need, replace=False)]
        if affine and abs(np.linalg.det(np.column_stack([pick[:, :2], np.ones(3)]))) > 1e-6:
            models.append(K.fit_affine(pick[:, :2], pick[:, 2:]).ravel())
        elif not affine and np.hypot(*(pick[0, :2] - pick[1, :2])) > 1e-6:
            models.append(K.fit_similarity(pick[:, :2], pick[:, 2:]).ravel())
    return np.array(models).reshape(-1, 6)


def _counted(models: np.ndarray, p: np.ndarray, threshold: float) -> np.ndarray:
    """How many rows (sx, sy, rx, ry) each model explains; blocks of rows against all models, in products of matrices."""
    out, step = np.zeros(len(models), np.int64), max(1, (1 << 20) // max(1, len(models)))
    for k in range(0, len(p), step):
        b = p[k : k + step]
        places = np.column_stack([b[:, :2], np.ones(len(b))])
        dx, dy = places @ models[:, :3].T, places @ models[:, 3:].T
        for d, to in ((dx, b[:, 2:3]), (dy, b[:, 3:4])):
            d -= to
            d *= d
        dx += dy
        out += np.count_nonzero(dx <= threshold * threshold, axis=0)
    return out


def _within(model: Sequence[float], threshold: float) -> Column:
    a, b, c, d, e, f = (F.lit(float(v)) for v in model)
    return F.hypot(a * F.col("sx") + b * F.col("sy") + c - F.col("rx"), d * F.col("sx") + e * F.col("sy") + f - F.col("ry")) <= threshold


_PLACES = ("sx", "sy", "rx", "ry")


def ransac_by_rows(points: DataFrame, threshold: float, hypotheses: int = 200, sample: int = 2000, seed: int = 7, affine: bool = True) -> tuple[np.ndarray | None, DataFrame]:
    """(model, inliers) over points that don't fit one task: hypotheses (affine, or similarities) are drawn from a small seeded
    sample of different points; all score all points, in Arrow batches against the matrix of models, of which a task gives one vector
    of counts; the best affine is fitted to its inliers by sums."""
    held = written(points.select(*(F.col(c).cast("double").alias(c) for c in _PLACES)), "places")
    first = held.distinct().orderBy(F.xxhash64(*_PLACES, F.lit(seed)), *_PLACES).limit(sample).toPandas().to_numpy()
    models = _hypotheses(first, hypotheses, affine, seed)
    if not len(models):
        return None, points.limit(0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(models), np.int64)
        for batch in batches:
            total += _counted(models, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]), threshold)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["k", "n"])

    best = held.mapInArrow(score, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "k").first()  # a row a model
    model = models[0 if best is None else best["k"]]
    if not affine:
        return model.reshape(2, 3), points.where(_within(model, threshold))
    fit = fit_affine_by_sums(held.where(_within(model, threshold)))
    model = model.reshape(2, 3) if fit is None else fit
    return model, points.where(_within(model.ravel(), threshold))


def robust_by_rows(points: DataFrame, by: str, threshold: float, affine: bool = False, hypotheses: int = 200, sample: int = 2000, seed: int = 7, chunk: int = 100_000) -> DataFrame:
    """robust_inliers for groups of any size: each group's hypotheses come from a bounded sample of its different points, its points
    are dealt out in chunks that meet the group's models, and the model with most points of all chunks wins, the first of equal ones."""
    kind = dict(points.dtypes)[by]
    held = written(points.select(F.col(by).alias("g"), *(F.col(c).cast("double").alias(c) for c in _PLACES)), "places")
    order = Window.partitionBy("g").orderBy(F.xxhash64(*_PLACES, F.lit(seed)), *_PLACES)
    drawn = held.distinct().withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= sample).drop("__k")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        models = _hypotheses(pdf.sort_values(list(_PLACES))[list(_PLACES)].to_numpy(), hypotheses, affine, seed)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * bool(len(models)), "models": [models.ravel().tolist()] * bool(len(models))})

    models = written(drawn.groupBy("g").applyInPandas(draw, f"g {kind}, models array<double>"), "models")
    chunks = held.groupBy("g").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    split = models.join(chunks, models["g"].eqNullSafe(chunks["g"])).select(models["g"], "models", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    dealt = held.join(chunks.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).withColumn("chunk", F.pmod(F.monotonically_increasing_id(), F.col("chunks")).cast("int"))

    def score(them: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        if not len(them) or not len(its):
            return pd.DataFrame({"g": [], "k": [], "n": [], "model": []})
        m = np.array(its["models"].iloc[0]).reshape(-1, 6)
        n = _counted(m, them[list(_PLACES)].to_numpy(), threshold)
        return pd.DataFrame({"g": [its["g"].iloc[0]] * len(m), "k": np.arange(len(m)), "n": n, "model": m.tolist()})

    scored = dealt.select("g", "chunk", *_PLACES).groupBy("g", "chunk").cogroup(split.groupBy("g", "chunk")).applyInPandas(score, f"g {kind}, k int, n long, model array<double>")
    total = scored.groupBy("g", "k").agg(F.sum("n").alias("n"), F.any_value("model").alias("m"))
    best = written(total.groupBy(F.col("g").alias("__g")).agg(F.max_by("m", F.struct("n", -F.col("k"))).alias("__m")), "best")
    m = [F.col("__m")[k] for k in range(6)]
    away = F.hypot(m[0] * F.col("sx") + m[1] * F.col("sy") + m[2] - F.col("rx"), m[3] * F.col("sx") + m[4] * F.col("sy") + m[5] - F.col("ry"))
    return points.join(best, F.col(by).eqNullSafe(F.col("__g"))).where(away <= threshold).select(*points.columns)


def fit_affine_by_sums(points: DataFrame) -> np.ndarray | None:
    """Least squares from one row of sums, centred first."""
    m = points.agg(*(F.avg(c).alias(c) for c in _PLACES), F.count("*").alias("n")).first()
    if not m["n"] or m["n"] < 3:
        return None
    d = {c: F.col(c) - F.lit(m[c]) for c in _PLACES}
    s = points.agg(*(F.sum(d[a] * d[b]).alias(f"{a}_{b}") for a in ("sx", "sy") for b in _PLACES)).first()
    a = np.array([[s["sx_sx"], s["sx_sy"]], [s["sy_sx"], s["sy_sy"]]])
    if abs(np.linalg.det(a)) < 1e-9:
        return None
    lin = np.linalg.solve(a, np.array([[s["sx_rx"], s["sx_ry"]], [s["sy_rx"], s["sy_ry"]]])).T
    return np.column_stack([lin, np.array([m["rx"], m["ry"]]) - lin @ np.array([m["sx"], m["sy"]])])


def cross_validated(points: DataFrame, residual: Sequence[str] = ("dx", "dy"), smoothing: float = 0.01, most: int = 5000) -> DataFrame:
    """(fold, n, sum_sq) of a thin-plate spline of residuals held out fold by fold. The spline's system is solved whole, so at
    most most points are taken: more are refused, not sampled. The points are broadcast to the folds' tasks."""
    spark = points.sparkSession
    rows = points.select("sx", "sy", *residual).orderBy("sy", "sx", *residual).limit(most + 1).toPandas().to_numpy()
    if len(rows) > most:
        raise ValueError(f"a spline over more than {most} points; choose a consensus first")
    shared, part = spark.sparkContext.broadcast(rows), K.folds(len(rows))
    n_folds = int(part.max()) + 1 if len(part) else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in batches:
            out = []
            for f in pdf["id"]:
                test = part == f
                spline = K.ThinPlate(p[~test, :2], p[~test, 2:], K.tps_smoothing(smoothing, len(p)))
                out.append((f, int(test.sum()), float(((spline(p[test, :2]) - p[test, 2:]) ** 2).sum())))
            yield pd.DataFrame(out, columns=["fold", "n", "sum_sq"])

    return spark.range(n_folds).repartition(max(1, min(n_folds, 64))).mapInPandas(run, "fold long, n long, sum_sq double")


# ---------------------------------------------------------------- warping


def warp(tiles: DataFrame, inverse: Callable[[np.ndarray], np.ndarray], height: int, width: int, block: int = 512, order: int = 3, dtype: str = "|u1", margin: int = 4, spline: Callable[[np.ndarray], np.ndarray] | None = None, sampler: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The source image (tiles) on an output grid: rows (row_off, col_off, h, w, dtype, px), a block each.

    inverse maps output places (x, y) to source places; spline, if any, is a smooth addition found on a sub-grid; sampler (image, y, x)
    takes the place of splines of an order, and reaches margin pixels at most. Each block's
    source box is known from its mapped places; source tiles join the blocks they touch by box, and a block is resampled
    from those alone. Blocks that map outside everywhere are nodata."""
    spark = tiles.sparkSession

    def source(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        yy, xx = np.meshgrid(y, x, indexing="ij")
        at = inverse(np.column_stack([xx.ravel(), yy.ravel()])).reshape(len(y), len(x), 2)
        return at + K.on_subgrid(spline, y, x) if spline is not None else at

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k in pdf["id"]:
                y0, x0 = (k // -(-width // block)) * block, (k % -(-width // block)) * block
                y, x = np.arange(y0, min(y0 + block, height), dtype=float), np.arange(x0, min(x0 + block, width), dtype=float)
                at = source(y[K.subgrid(len(y))], x[K.subgrid(len(x))])
                lo, hi = at.min((0, 1)), at.max((0, 1))
                rows.append((int(y0), int(x0), len(y), len(x), *(float(v) for v in (lo[1] - margin, hi[1] + margin, lo[0] - margin, hi[0] + margin))))
            yield pd.DataFrame(rows, columns=["y0", "x0", "bh", "bw", "s0", "s1", "t0", "t1"])

    n = -(-height // block) * -(-width // block)
    wanted = spark.range(n).repartition(max(1, min(n, 256))).mapInPandas(boxes, "y0 int, x0 int, bh int, bw int, s0 double, s1 double, t0 double, t1 double")
    cell = 512
    span = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("int"), F.floor(hi / cell).cast("int"))
    blocks = wanted.withColumn("gy", F.explode(span(F.greatest("s0", F.lit(-1.0)), F.greatest("s1", F.lit(-1.0))))).withColumn("gx", F.explode(span(F.greatest("t0", F.lit(-1.0)), F.greatest("t1", F.lit(-1.0)))))
    held = tiles.withColumn("gy", F.explode(span(F.col("row_off"), F.col("row_off") + F.col("h") - 1))).withColumn("gx", F.explode(span(F.col("col_off"), F.col("col_off") + F.col("w") - 1)))
    touch = (F.col("row_off") <= F.col("s1")) & (F.col("row_off") + F.col("h") > F.col("s0")) & (F.col("col_off") <= F.col("t1")) & (F.col("col_off") + F.col("w") > F.col("t0"))
    met = blocks.join(held, ["gy", "gx"], "left")
    kept = met.where(F.col("px").isNull() | touch).select("y0", "x0", "bh", "bw", "row_off", "col_off", "h", "w", "dtype", "px")

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0, bh, bw = (int(pdf[c].iloc[0]) for c in ("y0", "x0", "bh", "bw"))
        out = np.zeros((bh, bw))
        own = pdf[pdf["px"].notna()].drop_duplicates(["row_off", "col_off"])
        if len(own):
            r0, c0 = int(own["row_off"].min()), int(own["col_off"].min())
            r1, c1 = int((own["row_off"] + own["h"]).max()), int((own["col_off"] + own["w"]).max())
            image = np.zeros((r1 - r0, c1 - c0))
            for t in own.itertuples(index=False):
                y, x = int(t.row_off) - r0, int(t.col_off) - c0
                image[y : y + int(t.h), x : x + int(t.w)] = pixels_of(int(t.h), int(t.w), t.dtype, t.px)
            at = source(np.arange(y0, y0 + bh, dtype=float), np.arange(x0, x0 + bw, dtype=float))
            at = at[..., 1] - r0, at[..., 0] - c0
            out = K.sample(image, *at, order) if sampler is None else sampler(image, *at)
        return pd.DataFrame({"row_off": [y0], "col_off": [x0], "h": [bh], "w": [bw], "dtype": [dtype], "px": [K.cast_pixels(out, dtype).tobytes()]})

    return kept.groupBy("y0", "x0").applyInPandas(resample, "row_off int, col_off int, h int, w int, dtype string, px binary")


def array_of(tiles: DataFrame, height: int, width: int) -> np.ndarray:
    """Tiles as one array; for tests and previews."""
    rows = tiles.select("row_off", "col_off", "h", "w", "dtype", "px").collect()
    out = np.zeros((height, width), rows[0]["dtype"] if rows else "|u1")
    for r in rows:
        out[r["row_off"] : r["row_off"] + r["h"], r["col_off"] : r["col_off"] + r["w"]] = pixels_of(r["h"], r["w"], r["dtype"], bytes(r["px"]))
    return out


def fixed_point_inverse(forward: Callable[[np.ndarray], np.ndarray], rounds: int = 4) -> Callable[[np.ndarray], np.ndarray]:
    """Source places of reference places by fixed-point steps, for a forward map near the identity plus a shift."""

    def inverse(q: np.ndarray) -> np.ndarray:
        p = q.copy()
        for _ in range(rounds):
            p = p + (q - forward(p))
        return p

    return inverse
