"""Ground points of line-scanner pixels: epochs meet attitude and position samples by time, look vectors are turned into the target's
frame at the time the light left it, and meet a triaxial ellipsoid. All of it is column expressions and equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kilometres a second (fixed value).
LIGHT = 299792.458
Vector = tuple[Column, Column, Column]


def brackets(samples: DataFrame, by: str, time: str, values: Sequence[str], gap: float) -> DataFrame:
    """(by, bucket, t0, t1, a_*, b_*): each sample with the next one of its key, where that is at most gap later, in every bucket of time,
    gap wide, that they span. Samples meet their next by bucket, so a key's samples are never in one window, however many it has. Of
    samples at one time one stays."""
    b = F.floor(F.col("t") / gap).cast("long")
    held = samples.where(F.col(time).isNotNull()).select(F.col(by).alias("by"), F.col(time).cast("double").alias("t"), F.struct(*(F.col(c).cast("double").alias(c) for c in values)).alias("v"))
    held = held.groupBy("by", "t").agg(F.min("v").alias("v"))
    # A sample's next is in its bucket or the one after, whose samples come along for that.
    near = held.select("by", "t", "v", F.explode(F.array(b, b - 1)).alias("bucket"))
    order = Window.partitionBy("by", "bucket").orderBy("t")
    pairs = near.withColumns({"t1": F.lead("t").over(order), "w": F.lead("v").over(order)}).where((b == F.col("bucket")) & (F.col("t1") - F.col("t") <= gap))
    spans = F.explode(F.sequence(b, F.floor(F.col("t1") / gap).cast("long")))
    return pairs.select("by", spans.alias("bucket"), F.col("t").alias("t0"), "t1", *(F.col(f"v.{c}").alias(f"a_{c}") for c in values), *(F.col(f"w.{c}").alias(f"b_{c}") for c in values))


def at_times(epochs: DataFrame, by: str, time: str, found: DataFrame, gap: float) -> DataFrame:
    """epochs with the bracket (t0, t1, a_*, b_*) that holds their time, the later one where two meet; null where none does: the epoch is
    in a gap of coverage."""
    names = [c for c in found.columns if c not in ("by", "bucket")]
    keyed = epochs.withColumn("bucket", F.floor(F.col(time) / gap).cast("long"))
    f = found.withColumnRenamed("by", "__by").withColumnRenamed("bucket", "__bucket")
    # A time at a sample is held by the bracket that begins there, or, at the end of coverage, by the one that ends there.
    met = keyed.join(f, (F.col(by) == F.col("__by")) & (F.col("bucket") == F.col("__bucket")) & (F.col("t0") <= F.col(time)) & (F.col(time) <= F.col("t1")), "left")
    best = F.max_by(F.struct(*names), F.col("t0")).alias("__best")
    return met.groupBy(*epochs.columns).agg(best).select(*epochs.columns, *(F.col(f"__best.{n}").alias(n) for n in names))


def slerp(a: Sequence[Column], b: Sequence[Column], f: Column) -> tuple[Column, ...]:
    """The unit quaternion (w, x, y, z) a share f of the shorter way from a to b."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    sign, c = F.when(dot < 0, -1.0).otherwise(1.0), F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(c)
    near = angle < 1e-8
    p = F.when(near, 1 - f).otherwise(F.sin((1 - f) * angle) / F.sin(angle))
    q = sign * F.when(near, f).otherwise(F.sin(f * angle) / F.sin(angle))
    out = [p * x + q * y for x, y in zip(a, b, strict=True)]
    norm = F.sqrt(sum((x * x for x in out), F.lit(0.0)))
    return tuple(x / norm for x in out)


def hermite(a: Column, va: Column, b: Column, vb: Column, f: Column, span: Column) -> Column:
    """The cubic through two values with their rates, a share f of the span between."""
    g = f * f * f
    h = f * f
    return (2 * g - 3 * h + 1) * a + (g - 2 * h + f) * span * va + (3 * h - 2 * g) * b + (g - h) * span * vb


def turned(q: Sequence[Column], v: Vector) -> Vector:
    """A vector turned by a unit quaternion."""
    w, x, y, z = q
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return v[0] + w * tx + y * tz - z * ty, v[1] + w * ty + z * tx - x * tz, v[2] + w * tz + x * ty - y * tx


def about_pole(v: Vector, angle: Column) -> Vector:
    """A vector in a frame that has turned by an angle about z."""
    return F.cos(angle) * v[0] + F.sin(angle) * v[1], F.cos(angle) * v[1] - F.sin(angle) * v[0], v[2]


def on_ellipsoid(p: Vector, d: Vector, axes: tuple[float, float, float]) -> Column:
    """How many lengths of d from p the ellipsoid is first met; null where it isn't."""
    u, v = [x / r for x, r in zip(p, axes, strict=True)], [x / r for x, r in zip(d, axes, strict=True)]
    a, b, c = (sum((x * y for x, y in zip(s, t, strict=True)), F.lit(0.0)) for s, t in ((v, v), (u, v), (u, u)))
    disc = b * b - a * (c - 1)
    near = (-b - F.sqrt(F.greatest(disc, F.lit(0.0)))) / a
    return F.when((disc >= 0) & (near > 0), near)


def between_edges(left: tuple[float, float, float], right: tuple[float, float, float], share: Column) -> Vector:
    """The look vector, of length 1, a share of the way from one edge of the field of view to the other."""
    v = [a + (b - a) * share for a, b in zip(left, right, strict=True)]
    norm = F.sqrt(sum((x * x for x in v), F.lit(0.0)))
    return tuple(x / norm for x in v)


QUATERNION, STATE = ("w", "x", "y", "z"), ("px", "py", "pz", "vx", "vy", "vz")


def ground_points(
    pixels: DataFrame, attitude: DataFrame, position: DataFrame, left: tuple[float, float, float], right: tuple[float, float, float], axes: tuple[float, float, float],
    meridian: float = 0.0, rate: float = 0.0, gap: float = 1.0, rounds: int = 3, strict: bool = False, key: str = "craft",
) -> DataFrame:
    """pixels (key, t, share and others) with lon, lat in degrees, light_s and error. attitude (key, t, w, x, y, z) turns look vectors
    between the edges of the field (share from 0 to 1) into the inertial frame; position (key, t, px, py, pz, vx, vy, vz) is the craft's,
    from the target's middle, in kilometres. The target has turned by meridian + rate (t - light time) radians about z; light time is
    the fixed point of rounds steps. Both kernels cover a time between two samples at most gap seconds apart.

    error is null, "no attitude", "no position" or "misses"; with strict a time outside coverage fails the query."""
    numbered = pixels.withColumn("__n", F.monotonically_increasing_id())
    epochs = numbered.select(F.col(key).alias("by"), F.col("t").cast("double").alias("at")).distinct()  # a row for each line, not for each pixel
    turns = at_times(epochs, "by", "at", brackets(attitude, key, "t", QUATERNION, gap), gap)
    f = (F.col("at") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    q = slerp([F.col(f"a_{c}") for c in QUATERNION], [F.col(f"b_{c}") for c in QUATERNION], f)
    turns = turns.select("by", "at", *(x.alias(c) for x, c in zip(q, QUATERNION, strict=True)))
    places = at_times(turns, "by", "at", brackets(position, key, "t", STATE, gap), gap)
    span = F.col("t1") - F.col("t0")
    state = [hermite(F.col(f"a_p{c}"), F.col(f"a_v{c}"), F.col(f"b_p{c}"), F.col(f"b_v{c}"), f, span).alias(f"p{c}") for c in "xyz"]
    known = places.select("by", "at", *QUATERNION, *state).withColumnsRenamed({c: f"__{c}" for c in (*QUATERNION, "px", "py", "pz")})
    held = numbered.join(known, numbered[key].eqNullSafe(known["by"]) & numbered["t"].cast("double").eqNullSafe(known["at"]), "left")

    look = turned([F.col(f"__{c}") for c in QUATERNION], between_edges(left, right, F.col("share")))
    held = held.withColumns({f"__d{c}": x for c, x in zip("xyz", look, strict=True)}).withColumn("light_s", F.lit(0.0))
    p, d = (tuple(F.col(f"__{k}{c}") for c in "xyz") for k in "pd")
    for _ in range(rounds):
        angle = F.lit(meridian) + F.lit(rate) * (F.col("t").cast("double") - F.col("light_s"))
        held = held.withColumn("__far", on_ellipsoid(about_pole(p, angle), about_pole(d, angle), axes)).withColumn("light_s", F.col("__far") / LIGHT)
    angle = F.lit(meridian) + F.lit(rate) * (F.col("t").cast("double") - F.col("light_s"))
    bp, bd = about_pole(p, angle), about_pole(d, angle)
    held = held.withColumn("__far", on_ellipsoid(bp, bd, axes))
    x, y, z = (a + F.col("__far") * b for a, b in zip(bp, bd, strict=True))
    error = F.when(F.col("__w").isNull(), "no attitude").when(F.col("__px").isNull(), "no position").when(F.col("__far").isNull(), "misses")
    out = held.withColumns({"lon": F.degrees(F.atan2(y, x)), "lat": F.degrees(F.atan2(z, F.hypot(x, y))), "error": error})
    if strict:
        gone = F.col("error").isin("no attitude", "no position")
        out = out.withColumn("error", F.when(gone, F.raise_error(F.concat(F.col("error"), F.lit(" at "), F.coalesce(F.col("t").cast("string"), F.lit("null"))))).otherwise(F.col("error")))
    return out.select(*pixels.columns, "lon", "lat", "light_s", "error")
