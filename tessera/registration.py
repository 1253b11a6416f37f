"""From two rasters as tiles to a registered raster and a verdict.

Stages are DataFrames; the driver sees a few numbers where control flow depends on data: the coarse drift, how many points a
filter leaves, the model. Pixels and points stay distributed."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.functions.descriptors import dense_matcher
from tessera.operators import footprints, rasters
from tessera.operators import georeference as G
from tessera.operators import points as P
from tessera.operators import tiles as T
from tessera.sources.raw import decimated
from tessera.sources.shared import written

SENSORS_SRC, SENSORS_REF = ("OHRC", "TMC", "TMC_FWD", "TMC_AFT", "IIRS"), ("NAC", "WAC", "SELENE")


#: Known methods: of matching; of the coarse stage (auto tries a thumbnail first and then both others); of structural maps.
MATCHERS = {"dense": K.grid_matcher, "descriptors": dense_matcher}
METHODS, COARSE, STRUCTURAL = tuple(MATCHERS), ("auto", "fft", "crater"), ("none", "phase_congruency", "gradient", "hybrid")
#: Points from which an inverse model has a spline (fixed value of the interface).
LEAST_INVERSE = 25


@dataclass(frozen=True)
class RunConfig:
    """A run's options with their defaults."""

    sensor_src: str = "OHRC"
    sensor_ref: str = "NAC"
    method: str = "dense"
    structural_method: str = "none"
    coarse_method: str = "auto"
    poly_degree: int = 2
    tps_smoothing: float = 0.05
    warp_order: int = 3
    ransac_threshold: float = 1.2
    wac_band: int = 7
    grid_rows: int = 4
    grid_cols: int = 4
    tile_size: int = 1600
    step_size: int = 1200
    search_padding: int = 64
    patch: int = 64
    most_points: int = 800
    target_rmse: float = 0.5
    manual_dx: float | None = None
    manual_dy: float | None = None

    def __post_init__(self) -> None:
        limits = {"poly_degree": (0, 4), "tps_smoothing": (0, 10), "warp_order": (0, 5), "wac_band": (1, 7), "grid_rows": (1, 16), "grid_cols": (1, 16)}
        for name, (lo, hi) in limits.items():
            if not lo <= getattr(self, name) <= hi:
                raise ValueError(f"{name} must be in [{lo}, {hi}]")
        if not 0 < self.ransac_threshold <= 100:
            raise ValueError("ransac_threshold must be in (0, 100]")
        for name, known in (("method", METHODS), ("coarse_method", COARSE), ("structural_method", STRUCTURAL)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")


@dataclass
class Coarse:
    dx: float
    dy: float
    confidence: float
    slope: tuple[float, float] = (0.0, 0.0)
    intercept: tuple[float, float] = (0.0, 0.0)
    method: str = "fourier"


@dataclass
class Model:
    """Affine, drift polynomials of the normalised row, and a thin-plate spline; later layers add to earlier ones."""

    affine: list[list[float]]
    px: list[float] = field(default_factory=lambda: [0.0])
    py: list[float] = field(default_factory=lambda: [0.0])
    y_mean: float = 0.0
    y_std: float = 1.0
    smoothing: float = 0.05
    source: list[list[float]] = field(default_factory=list)
    reference: list[list[float]] = field(default_factory=list)
    spline_active: bool = False
    stats: dict = field(default_factory=dict)

    def _smooth(self, p: np.ndarray) -> np.ndarray:
        yn = (p[:, 1] - self.y_mean) / self.y_std
        return K.applied(np.array(self.affine), p) + np.column_stack([np.polyval(self.px, yn), np.polyval(self.py, yn)])

    def _spline(self) -> K.ThinPlate | None:
        if not self.spline_active:
            return None
        s, r = np.array(self.source), np.array(self.reference)
        return K.ThinPlate(s, r - self._smooth(s), self.smoothing)

    def predict(self, p: np.ndarray, spline: bool = True) -> np.ndarray:
        out = self._smooth(p)
        f = self._spline() if spline else None
        return out if f is None else out + f(p)

    def inverse(self) -> Model:
        """Reference to source: the exact inverse affine; polynomials and, from LEAST_INVERSE points on, the spline are fitted again
        to the swapped points."""
        m = np.array(self.affine)
        lin = np.linalg.inv(m[:, :2])
        back = np.column_stack([lin, -lin @ m[:, 2]])
        s, r = np.array(self.reference).reshape(-1, 2), np.array(self.source).reshape(-1, 2)
        if len(s) < 3:
            shift = lin @ np.array([np.polyval(self.px, 0.0), np.polyval(self.py, 0.0)])
            return Model(back.tolist(), [-float(shift[0])], [-float(shift[1])], stats=dict(self.stats))
        mean, std = float(s[:, 1].mean()), max(1.0, float(s[:, 1].std()))
        left, degree = r - K.applied(back, s), len(self.px) - 1
        fit = lambda v: np.polyfit((s[:, 1] - mean) / std, v, degree).tolist()
        return Model(back.tolist(), fit(left[:, 0]), fit(left[:, 1]), mean, std, self.smoothing, s.tolist(), r.tolist(), self.spline_active and len(s) >= LEAST_INVERSE, dict(self.stats))

    def scaled(self, k: float) -> Model:
        """The model in pixels k times as many: every length grows by k, also the polynomials' values, as their argument is
        normalised."""
        m = np.array(self.affine)
        grow = lambda v: (np.array(v) * k).tolist()
        return Model(np.column_stack([m[:, :2], m[:, 2] * k]).tolist(), grow(self.px), grow(self.py), self.y_mean * k, self.y_std * k, self.smoothing, grow(self.source), grow(self.reference), self.spline_active, dict(self.stats))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Model:
        """Keys that older files lack take their defaults."""
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})


# ---------------------------------------------------------------- coarse


#: Longest side of a thumbnail, and the share of a strip's patch that must hold data.
THUMBNAIL, LEAST_DATA = 1024, 0.2


def thumbnails(source: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """One row with both rasters, decimated by k, as patches; their size is bounded by the choice of k."""
    import pandas as pd

    def whole(tiles: DataFrame) -> DataFrame:
        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1))
            out[pdf["row"], pdf["col"]] = pdf["v"]
            return pd.DataFrame({"id": [0], "h": [out.shape[0]], "w": [out.shape[1]], "dtype": ["<f8"], "px": [out.tobytes()]})

        return decimated(tiles, k).withColumn("id", F.lit(0)).groupBy("id").applyInPandas(pack, "id int, h int, w int, dtype string, px binary")

    return T.paired(whole(source), whole(reference), "id")


def _equal(a: np.ndarray) -> np.ndarray:
    return K.clahe(K.stretched(a.astype(float)), 3.0).astype(float)


def strip_boxes(spark: SparkSession, height: int, width: int, anchor: tuple[float, float], strips: int, patch: int) -> DataFrame:
    """A row for each strip: its middle row, its patch's box in the middle of the source (y0, y1, x0, x1), and the reference's box (ry0,
    ...) moved by the anchor and kept inside."""
    h, w = min(patch, height), min(patch, width)
    x0 = max(0, min(width - w, width // 2 - patch // 2))
    rx0 = max(0, min(width - w, round(x0 + anchor[0])))
    ry0 = F.greatest(F.lit(0), F.least(F.lit(height - h), F.rint(F.col("y0") + anchor[1]).cast("int")))
    out = P.strip_samples(spark, height, strips, patch).withColumns({"x0": F.lit(x0), "x1": F.lit(x0 + w), "rx0": F.lit(rx0), "rx1": F.lit(rx0 + w), "ry0": ry0})
    return out.withColumn("ry1", F.col("ry0") + h)


def strip_offsets(source: DataFrame, reference: DataFrame, height: int, width: int, anchor: tuple[float, float], config: RunConfig, strips: int = 10, patch: int = 2048) -> DataFrame:
    """(strip_idx, row, dx, dy, response, votes, method_used): each strip's offset by phase correlation of structural maps, by votes of
    circles where the method asks for them, or by what arbitration makes of both. Strips without data enough are left out."""
    boxes = strip_boxes(source.sparkSession, height, width, anchor, strips, patch)
    a = windows_of(source, boxes.select("strip_idx", "y0", "y1", "x0", "x1"), "strip_idx")
    b = windows_of(reference, boxes.select("strip_idx", *(F.col(f"r{c}").alias(c) for c in ("y0", "y1", "x0", "x1"))), "strip_idx")
    method = config.structural_method
    shifts = T.phase_shift(T.paired(a, b, "strip_idx"), "strip_idx", (lambda x: x) if method == "none" else (lambda x: K.structural(x, method)), LEAST_DATA)
    shifts = shifts.withColumnsRenamed({"dx": "fdx", "dy": "fdy"})
    if config.coarse_method == "fft":
        both = shifts.withColumns({"vdx": F.lit(None).cast("double"), "vdy": F.lit(None).cast("double"), "votes": F.lit(0).cast("long")})
    else:
        most = min(1500, max(500, int(0.08 * height)))
        found = [T.found_circles(T.equalised(x, 3.0), "strip_idx") for x in (a, b)]
        peak = P.vote_peak(P.radius_votes(*found, most, by=["strip_idx"]), most, by=["strip_idx"])
        both = shifts.join(peak.withColumnsRenamed({"dx": "vdx", "dy": "vdy"}), "strip_idx", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    chosen = P.arbitrate(both, forced=config.coarse_method == "crater").join(boxes, "strip_idx")
    return chosen.select("strip_idx", "row", (F.col("dx") + F.col("rx0") - F.col("x0")).alias("dx"), (F.col("dy") + F.col("ry0") - F.col("y0")).alias("dy"), "response", "votes", "method_used")


def coarse(source: DataFrame, reference: DataFrame, height: int, width: int, config: RunConfig, strips: int = 10, patch: int = 2048, matcher=K.grid_matcher) -> Coarse:
    """The drift of the reference against the source. A given one counts; auto takes the thumbnails' if that stands alone; else
    strips, around the thumbnails' shift, and the robust line through them or their median."""
    if config.manual_dx is not None and config.manual_dy is not None:
        return Coarse(config.manual_dx, config.manual_dy, 1.0, intercept=(config.manual_dx, config.manual_dy), method="manual")
    k = max(1, -(-max(height, width) // THUMBNAIL))
    small, spark = thumbnails(source, reference, k), source.sparkSession
    thumb = None
    if config.coarse_method == "auto":
        thumb = G.thumbnail_drift(T.matched(small, "id", lambda a, b: matcher(_equal(a), _equal(b))), 1.0 / k, height)
        if G.thumbnail_accepted(thumb, height):
            return Coarse(thumb.dx, thumb.dy, thumb.confidence, thumb.slope, (thumb.dx, thumb.dy), "thumbnail")
    if thumb is not None:
        at = (thumb.dx, thumb.dy)
    else:
        found = T.phase_shift(small, "id", _equal).first()
        at = G.anchor(found["dx"], found["dy"], found["response"], 1.0 / k) if found else (0.0, 0.0)
    rows = strip_offsets(source, reference, height, width, at, config, strips, patch).orderBy("strip_idx").toPandas()  # a row for each strip
    if not len(rows):
        return Coarse(0.0, 0.0, 0.0, method="none")
    table = spark.createDataFrame(rows[["row", "dx", "dy"]]).withColumns({"sy": F.col("row").cast("double"), "sx": F.lit(0.0), "rx": F.col("dx"), "ry": F.col("row") + F.col("dy")})
    line = P.drift_regression(P.mad_inliers(table, ["dx", "dy"], floor=45.0)).withColumns({f"{c}_median": F.lit(float(rows[c].median())) for c in ("dx", "dy")})
    line, dx, dy = P.capped_drift(line).first(), float(rows["dx"].median()), float(rows["dy"].median())
    seen, method = float(rows["response"].mean()), "hybrid" if (rows["method_used"] != "fourier").any() else "fourier"
    if line["n"] < 3:
        return Coarse(dx, dy, seen, intercept=(dx, dy), method=method)
    return Coarse(dx, dy, seen, (line["dx_slope"], line["dy_slope"]), (line["dx_intercept"], line["dy_intercept"]), method)


# ---------------------------------------------------------------- matching


def windows_of(tiles: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(key, h, w, dtype, px): for each box (key, y0, y1, x0, x1) its pixels, from the tiles that it touches. Boxes and tiles
    meet by grid cell, so the join is by key; a task holds one box."""
    import pandas as pd

    cell = 1024
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor((b - 1) / cell).cast("int"))
    left = boxes.withColumn("gy", F.explode(span("y0", F.col("y1")))).withColumn("gx", F.explode(span("x0", F.col("x1"))))
    right = tiles.withColumn("gy", F.explode(span("row_off", F.col("row_off") + F.col("h")))).withColumn("gx", F.explode(span("col_off", F.col("col_off") + F.col("w"))))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, y1, x0, x1 = (int(pdf[c].iloc[0]) for c in ("y0", "y1", "x0", "x1"))
        out = np.zeros((y1 - y0, x1 - x0))
        for t in pdf.drop_duplicates(["row_off", "col_off"]).itertuples(index=False):
            ya, yb, xa, xb = max(y0, t.row_off), min(y1, t.row_off + t.h), max(x0, t.col_off), min(x1, t.col_off + t.w)
            if yb > ya and xb > xa:
                out[ya - y0 : yb - y0, xa - x0 : xb - x0] = T.pixels_of(t.h, t.w, t.dtype, t.px)[ya - t.row_off : yb - t.row_off, xa - t.col_off : xb - t.col_off]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "h": [out.shape[0]], "w": [out.shape[1]], "dtype": ["<f8"], "px": [out.tobytes()]})

    met = left.join(right.select("gy", "gx", "row_off", "col_off", "h", "w", "dtype", "px"), ["gy", "gx"])
    kind = boxes.select(key).dtypes[0][1]
    return met.groupBy(key).applyInPandas(cut, f"{key} {kind}, h int, w int, dtype string, px binary")


def search_padding(spark: SparkSession, drift: Coarse, config: RunConfig, height: int) -> int:
    """How far around its predicted place a tile is searched, by the one rule of points.padding()."""
    rule = P.padding(F.lit(float(drift.confidence)), F.lit(float(np.hypot(*drift.intercept))), F.lit(int(height)), config.search_padding)
    return int(spark.range(1).select(rule).first()[0])


def match(source: DataFrame, reference: DataFrame, shape: tuple[int, int], ref_shape: tuple[int, int], drift: Coarse, config: RunConfig, matcher=K.grid_matcher) -> DataFrame:
    """Tie points (tile_id, sx, sy, rx, ry, score): tiles against their search windows, a similarity per tile, and each point kept by
    the one tile whose core holds it."""
    spark, (h, w) = source.sparkSession, shape
    size, step = (min(config.tile_size, 1200), 800) if max(h, ref_shape[0]) > 3500 and config.step_size > 800 else (config.tile_size, config.step_size)
    grid = P.tile_grid(spark, h, w, size, step)
    windows = P.search_windows(grid, drift.slope, drift.intercept, search_padding(spark, drift, config, max(h, ref_shape[0])), *ref_shape)
    boxes = windows.select("tile_id", "y0", "y1", "x0", "x1")
    searched = windows.select("tile_id", F.col("wy0").cast("int").alias("y0"), F.col("wy1").cast("int").alias("y1"), F.col("wx0").cast("int").alias("x0"), F.col("wx1").cast("int").alias("x1"))

    def within(a: np.ndarray, b: np.ndarray):
        if (a > 0).mean() < 0.1 or (b > 0).mean() < 0.1:
            return np.zeros((0, 2)), np.zeros((0, 2)), np.zeros(0)
        if config.structural_method != "none":
            return matcher(K.structural(a, config.structural_method), K.structural(b, config.structural_method))
        return matcher(K.stretched(a).astype(float), K.stretched(b).astype(float))

    pairs = T.paired(windows_of(source, boxes, "tile_id"), windows_of(reference, searched, "tile_id"), "tile_id")
    local = P.confidence_filter(T.matched(pairs, "tile_id", within), "tile_id")
    kept = T.robust_inliers(local, "tile_id", 5.0)
    placed = kept.join(windows, "tile_id")
    moved = placed.withColumns({"sx": F.col("sx") + F.col("x0"), "sy": F.col("sy") + F.col("y0"), "rx": F.col("rx") + F.col("wx0"), "ry": F.col("ry") + F.col("wy0")})
    core = (F.col("sx") >= F.col("xcore0")) & (F.col("sx") < F.col("xcore1")) & (F.col("sy") >= F.col("ycore0")) & (F.col("sy") < F.col("ycore1"))
    points = moved.where(core).select("tile_id", "sx", "sy", "rx", "ry", "score")
    return P.drift_filter(points, drift.slope, drift.intercept, max(h, ref_shape[0]), drift.confidence)


def refined(source: DataFrame, reference: DataFrame, points: DataFrame, shape: tuple[int, int], ref_shape: tuple[int, int], config: RunConfig) -> DataFrame:
    """Sub-pixel points of a uniform subsample whose patches lie inside both rasters."""
    half = config.patch // 2
    order = ["sy", "sx", "ry", "rx"]
    inside = P.border_reject(P.uniform_subsample(points, order, config.most_points), half, shape, ref_shape)
    named = inside.withColumn("point", F.xxhash64("sx", "sy", "rx", "ry"))
    box = lambda x, y: named.select("point", *((F.rint(c).cast("int") + F.lit(d)).alias(n) for n, c, d in (("y0", y, -half), ("y1", y, half), ("x0", x, -half), ("x1", x, half))))
    pairs = T.paired(windows_of(source, box("sx", "sy"), "point"), windows_of(reference, box("rx", "ry"), "point"), "point")
    threshold = 0.60 if config.sensor_src == config.sensor_ref else 0.45
    offsets = T.subpixel(pairs, "point", threshold)
    return P.snapped(named.drop("score").join(offsets, "point"))


# ---------------------------------------------------------------- model


def fit(points: np.ndarray, shape: tuple[int, int], config: RunConfig) -> Model | None:
    """The layered model of tie points (rows sx, sy, rx, ry): at most a few thousand, after refinement."""
    if len(points) < 6:
        return None
    s, r, dim = points[:, :2], points[:, 2:4], max(shape)
    t = max(config.ransac_threshold, min(5.5, 0.00033 * dim)) if dim > 5000 else config.ransac_threshold
    span = lambda ok: np.ptp(s[ok, 1]) if ok.any() else 0.0
    m, ok = K.ransac(s, r, t)
    if m is None or ok.sum() < min(15, len(s) // 2) or span(ok) < 0.5 * np.ptp(s[:, 1]):
        m, ok = K.ransac(s, r, float(np.clip(1.5 * t, 3.5, 5.0)))
    if m is None:
        return None
    for wider in (K.fit_similarity, lambda a, b: K.fit_similarity(a, b, False)):
        scales = np.linalg.svd(m[:, :2], compute_uv=False)
        if 0.92 <= scales.min() and scales.max() <= 1.08:
            break
        m = wider(s[ok], r[ok])
    s, r = s[ok], r[ok]
    left = r - K.applied(m, s)
    mean, std = float(s[:, 1].mean()), max(1.0, float(s[:, 1].std()))
    yn = (s[:, 1] - mean) / std
    degree = P.effective_degree(config.poly_degree, len(np.unique(np.rint(yn * 10))), np.ptp(s[:, 1]) / max(1.0, shape[0]))
    px, py = (np.polyfit(yn, left[:, k], degree).tolist() for k in (0, 1))
    model = Model(m.tolist(), px, py, mean, std)
    err = np.hypot(*(r - model.predict(s)).T)
    if dim > 5000 and len(s) >= 20:
        keep = _consensus(s[:, 1], err)
        if 12 <= keep.sum() < len(s):
            s, r = s[keep], r[keep]
            left, yn = r - K.applied(m, s), (s[:, 1] - mean) / std
            model = replace(model, px=np.polyfit(yn, left[:, 0], degree).tolist(), py=np.polyfit(yn, left[:, 1], degree).tolist())
    coverage = K.hull_area(s) / max(1.0, shape[0] * shape[1])
    reach = np.ptp(s[:, 1]) / max(1.0, shape[0])
    layers = {"rmse_affine": _rmse(r - K.applied(m, s)), "rmse_drift": _rmse(r - model.predict(s)), "inlier_count": len(s), "total_points": len(points), "coverage": coverage, "span": reach}
    active = len(s) >= 15 and (coverage >= 0.02 or reach >= 0.30)
    model = replace(model, smoothing=K.tps_smoothing(config.tps_smoothing, len(s)), source=s.tolist(), reference=r.tolist(), spline_active=active)
    return replace(model, stats=layers | {"rmse_final": _rmse(r - model.predict(s))})


def _rmse(d: np.ndarray) -> float:
    return float(np.sqrt((d**2).sum(1).mean())) if len(d) else 0.0


def _consensus(y: np.ndarray, err: np.ndarray, bins: int = 6) -> np.ndarray:
    """The small counterpart of points.stratified_consensus(), on the driver's few points."""
    keep = np.zeros(len(y), bool)
    k = np.clip(np.floor((y - y.min()) / max(np.ptp(y) / bins, 1e-12)), 0, bins - 1)
    for b in range(bins):
        own = np.flatnonzero(k == b)
        if len(own):
            own = own[np.argsort(err[own], kind="stable")]
            med = np.median(err[own])
            cut = np.clip(med + 1.5 * 1.4826 * np.median(np.abs(err[own] - med)), 0.80, 1.80)
            keep[own[: min(25, max(6, int((err[own] <= cut).sum())))]] = True
    sharp = keep & (err <= 1.15)
    if sharp.sum() >= 15:
        keep = sharp
    if keep.sum() < 15:
        keep[np.argsort(err, kind="stable")[:25]] = True
    return keep


def model_or_shift(refined_points: np.ndarray, candidates: np.ndarray, drift: Coarse, shape: tuple[int, int], config: RunConfig) -> Model:
    """Refined points if they carry a model, else candidates, else the coarse shift. Refined points on (nearly) one row get the
    candidates beside them."""
    pool = refined_points
    if len(pool) >= 6 and np.ptp(pool[:, 1]) < max(100.0, 0.03 * shape[0]) and len(candidates):
        pool = np.unique(np.vstack([pool[:, :4], candidates[:, :4]]), axis=0)
    for points in (pool, candidates):
        if len(points) >= 6 and (model := fit(points[:, :4], shape, config)) is not None:
            return model
    return Model([[1.0, 0.0, drift.dx], [0.0, 1.0, drift.dy]], stats={"fallback": "translation"})


# ---------------------------------------------------------------- verification


@dataclass(frozen=True)
class Active:
    """What of a scene both rasters have data in: its share, and the cells of the grid of which over a hundredth has."""

    share: float
    cells: int


def active_area(registered: DataFrame, reference: DataFrame, shape: tuple[int, int], config: RunConfig, most: int = 1024) -> Active | None:
    """Of averages of blocks, at most most to a side, of both rasters' tiles; none if they have nothing in common."""
    k = max(1, -(-max(shape) // most))
    h, w = -(-shape[0] // k), -(-shape[1] // k)
    a, b = (decimated(t, k).select("row", "col", F.col("v").alias(n)) for t, n in ((registered, "a"), (reference, "b")))
    both = written(a.join(b, ["row", "col"]).where((F.col("row") < h) & (F.col("col") < w)).select("row", "col", ((F.col("a") > 0) & (F.col("b") > 0)).alias("ok")), "active")
    n = both.agg(F.count_if("ok")).first()[0]
    return Active(n / (h * w), P.active_cells(both, config.grid_rows, config.grid_cols, h, w).first()["active"]) if n else None


def wide_angle_tiles(lines: DataFrame, config: RunConfig, image_id: str = "wac", size: int = 512) -> DataFrame:
    """The run's band (wac_band) of a push-frame stream (line, sample, v) as tiles."""
    import pandas as pd

    rows = rasters.deinterleave(lines, config.wac_band)
    at = rows.select((F.floor(F.col("row") / size)).cast("int").alias("ty"), F.floor(F.col("sample") / size).cast("int").alias("tx"), F.col("row").cast("int").alias("row"), F.col("sample").cast("int").alias("col"), F.col("v").cast("double").alias("v"))
    at = at.join(at.groupBy("ty", "tx").agg(F.max("row").alias("bottom"), F.max("col").alias("right")), ["ty", "tx"])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = int(pdf["ty"].iloc[0]) * size, int(pdf["tx"].iloc[0]) * size
        a = np.zeros((int(pdf["bottom"].iloc[0]) - y + 1, int(pdf["right"].iloc[0]) - x + 1))
        a[pdf["row"] - y, pdf["col"] - x] = pdf["v"]
        return pd.DataFrame({"image_id": [image_id], "row_off": [y], "col_off": [x], "h": [a.shape[0]], "w": [a.shape[1]], "dtype": [a.dtype.str], "px": [a.tobytes()]})

    return at.groupBy("ty", "tx").applyInPandas(pack, T.TILE)


def verify(spark: SparkSession, model: Model, shape: tuple[int, int], config: RunConfig, active: Active | None = None) -> DataFrame:
    """One row of measures and the verdict; the hull's share and the most that the entropy can be are those of the active area, if it is
    known. Without tie points measures are null: nothing is made up."""
    s, r = np.array(model.source).reshape(-1, 2), np.array(model.reference).reshape(-1, 2)
    if len(s) < 3:
        return spark.range(1).select(F.lit("UNCERTAIN (No valid tie-point model residuals)").alias("verdict"), *(F.lit(None).cast("double").alias(c) for c in ("rmse", "rmse_cv", "entropy", "hull", "score")), F.lit(0).cast("long").alias("inliers"), F.lit("fallback_estimate").alias("provenance"))
    left = r - model.predict(s)
    frame = spark.createDataFrame(np.column_stack([s, r, left]).tolist(), "sx double, sy double, rx double, ry double, dx double, dy double")
    stats = P.residual_stats(frame)
    h, w = shape
    entropy = P.spatial_entropy(frame, "rx", "ry", w, h, config.grid_rows, config.grid_cols)
    cv = None
    if model.spline_active and len(s) >= 8:
        drift = r - model.predict(s, spline=False)
        held = spark.createDataFrame(np.column_stack([s, drift]).tolist(), "sx double, sy double, dx double, dy double")
        out = T.cross_validated(held, smoothing=config.tps_smoothing).agg(F.sqrt(F.sum("sum_sq") / F.sum("n"))).first()
        cv = out[0]
    hull = K.hull_share(r, float(h * w) * (1.0 if active is None else max(0.1, active.share)))
    cells = config.grid_rows * config.grid_cols if active is None else active.cells
    one = stats.crossJoin(F.broadcast(entropy)).withColumns({"rmse_cv": F.lit(cv).cast("double"), "hull": F.lit(hull), "inliers": F.lit(len(s)).cast("long"), "ratio": F.lit(len(s) / max(1, model.stats.get("total_points", len(s))))})
    eff = P.effective_rmse(F.col("rmse"), F.col("rmse_cv"))
    score = P.composite_score(eff, F.col("entropy") / float(np.log2(max(2, cells))), F.col("ratio"), F.col("inliers"), F.col("hull"))
    judged = one.withColumns({"effective_rmse": eff, "score": score})
    return judged.select(P.verdict(F.col("inliers"), F.col("hull"), F.col("entropy"), F.col("effective_rmse"), F.col("score"), target=config.target_rmse).alias("verdict"), "rmse", "rmse_cv", "entropy", "hull", "score", "inliers", P.precision_tier(F.col("effective_rmse")).alias("tier"), F.lit("tie_point_model_residuals").alias("provenance"))


# ---------------------------------------------------------------- one grid


@dataclass(frozen=True)
class Place:
    """Where a raster of height x width pixels lies: pixel sizes (a, e) and the upper left corner's metres (c, f)."""

    a: float
    c: float
    e: float
    f: float
    height: int
    width: int

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self.c, self.f + self.e * self.height, self.c + self.a * self.width, self.f


@dataclass
class OneGrid:
    source: DataFrame
    reference: DataFrame
    grid: G.Grid
    method: str
    native: tuple[DataFrame, G.Grid] | None = None


def on_one_grid(source: DataFrame, at: Place, reference: DataFrame, ref_at: Place, wide_angle: bool = False) -> OneGrid:
    """Both rasters on the grid of the part that they share, in the harmonised GSD, with the resampler that the ratio of their scales
    asks for; against a wide-angle reference of at least three times the pixel also the source in its own GSD."""
    left, bottom = max(at.box[0], ref_at.box[0]), max(at.box[1], ref_at.box[1])
    right, top = min(at.box[2], ref_at.box[2]), min(at.box[3], ref_at.box[3])
    if left >= right or bottom >= top:
        raise ValueError("the rasters share no part")
    own, other, wide = F.lit(abs(at.a)), F.lit(abs(ref_at.a)), F.lit(wide_angle)
    ratio = footprints.gsd_ratio(own, other)
    rule = source.sparkSession.range(1).select(footprints.harmonized_gsd(own, other, wide).alias("gsd"), footprints.resampler(ratio).alias("method"), footprints.native_crop(wide, ratio).alias("native")).first()
    box = (left, bottom, right, top)
    grid = G.common_grid(box, rule["gsd"])
    onto = lambda tiles, place, g, method: G.harmonised(tiles, (place.a, place.c, place.e, place.f), g, method)
    native = G.common_grid(box, abs(at.a)) if rule["native"] else None
    return OneGrid(onto(source, at, grid, rule["method"]), onto(reference, ref_at, grid, rule["method"]), grid, rule["method"], None if native is None else (onto(source, at, native, "bilinear"), native))


@dataclass
class Registration:
    drift: Coarse
    candidates: DataFrame
    model: Model
    registered: DataFrame
    report: DataFrame


def register(source: DataFrame, reference: DataFrame, shape: tuple[int, int], ref_shape: tuple[int, int], config: RunConfig = RunConfig(), places: tuple[Place, Place] | None = None) -> Registration:
    """The whole run on two rasters. With places they are brought onto one grid first; without, they are on the same grid."""
    if places is not None:
        one = on_one_grid(source, places[0], reference, places[1], config.sensor_ref == "WAC")
        source, reference = (written(x, "harmonised").withColumn("image_id", F.lit(n)) for x, n in ((one.source, "source"), (one.reference, "reference")))
        shape = ref_shape = (one.grid.height, one.grid.width)
    matcher = MATCHERS[config.method]
    drift = coarse(source, reference, min(shape[0], ref_shape[0]), min(shape[1], ref_shape[1]), config, matcher=matcher)
    candidates = written(match(source, reference, shape, ref_shape, drift, config, matcher), "candidates")
    rows = lambda df: df.select("sx", "sy", "rx", "ry").orderBy("sy", "sx").toPandas().to_numpy()
    few = P.uniform_subsample(candidates, ["sy", "sx", "ry", "rx"], config.most_points)
    fine = refined(source, reference, candidates, shape, ref_shape, config)
    model = model_or_shift(rows(fine), rows(few), drift, shape, config)
    back = model.inverse()
    spline = back._spline()
    out = written(T.warp(source, lambda p: back.predict(p, spline=False), *ref_shape, order=config.warp_order, spline=spline), "registered")
    return Registration(drift, candidates, model, out, verify(source.sparkSession, model, ref_shape, config, active_area(out, reference, ref_shape, config)))
