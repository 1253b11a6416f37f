"""The job store's queries, and artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a job's parameters, ends included; None: open below.
RANGES = {"poly_degree": (0, 4), "tps_smoothing": (0.0, 10.0), "warp_order": (0, 5), "wac_band": (1, 7), "grid_rows": (1, 16), "grid_cols": (1, 16)}
SUFFIXES = (".xml", ".lbl", ".img", ".tif", ".tiff", ".h5", ".hdf5")
SIDECAR_SUFFIXES = (*SUFFIXES, ".dat", ".bin")
MOST_SIDECARS, MOST_BYTES, MOST_PREVIEW_BYTES, EVENTS_KEPT = 16, 20 * 1024**3, 8 * 1024**2, 40
#: File types of typed downloads (fixed names of the interface).
DOWNLOADS = ("registered_tif", "native_tif", "heatmap_png", "candidate_csv", "subpixel_csv", "hybrid_model_json", "metrics_json", "registered_preview", "sidebyside_png", "falsecolor_png")


def violations(jobs: DataFrame) -> DataFrame:
    """jobs with an array of the names of parameters out of range."""
    bad = [F.when(~F.col(k).between(lo, hi), k) for k, (lo, hi) in RANGES.items()]
    bad.append(F.when(~((F.col("ransac_threshold") > 0) & (F.col("ransac_threshold") <= 100)), "ransac_threshold"))
    return jobs.withColumn("violations", F.array_compact(F.array(*bad)))


def upload_checks(files: DataFrame) -> DataFrame:
    """Per job of files (job_id, side, idx, name, bytes; idx 0 is the product): too many sidecars, repeated names whatever
    their case, too many bytes."""
    per_side = files.groupBy("job_id", "side").agg(F.count("*").alias("n"), F.countDistinct(F.lower("name")).alias("names"), F.sum("bytes").alias("bytes"), F.count_if(F.col("idx") > 0).alias("sidecars"))
    return per_side.groupBy("job_id").agg((F.sum("sidecars") > MOST_SIDECARS).alias("too_many"), F.bool_or(F.col("n") != F.col("names")).alias("repeated"), (F.sum("bytes") > MOST_BYTES).alias("too_large"))


def page(jobs: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(a row with the total, a page of jobs in a total order)."""
    return jobs.agg(F.count("*").alias("total")), jobs.orderBy(*order).offset(max(0, skip)).limit(min(100, max(1, limit)))


def reconciled(jobs: DataFrame, status: str = "status") -> DataFrame:
    """Jobs that a stopped service left pending or at work have failed."""
    stale = F.col(status).isin("PENDING", "PROCESSING")
    return jobs.withColumn("reconciled", stale).withColumn(status, F.when(stale, "FAILED").otherwise(F.col(status)))


def transitions_allowed(before: Column, after: Column) -> Column:
    return ((before == "PENDING") & after.isin("PROCESSING", "FAILED")) | ((before == "PROCESSING") & after.isin("SUCCESS", "FAILED"))


def without(jobs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return jobs.join(gone.select(key), key, "left_anti")


def merged(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates replace rows with their key; other columns are added to either side as null."""
    return table.join(updates.select(key), key, "left_anti").unionByName(updates, allowMissingColumns=True)


def latest_events(events: DataFrame, by: str, order: Sequence[Column], most: int = EVENTS_KEPT) -> DataFrame:
    """Each job's newest events. Ranking in windows is partial per task first (Spark keeps the top of each group)."""
    return events.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= most)


def job_state(events: DataFrame, by: str, at: Column) -> DataFrame:
    return events.groupBy(by).agg(F.max_by("title", at).alias("current_stage"), F.max_by("progress_pct", at).alias("progress_pct"), F.count("*").alias("n_events"))


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    q, hit = F.lit(text.lower()), F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), q), F.lit(False))
    return df.where(hit)


# ---------------------------------------------------------------- files


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def safe_name(name: Column, sidecar: bool = False) -> Column:
    """The file's name without folders and unusual characters; null if its suffix isn't taken."""
    clean = F.regexp_replace(file_name(name), r"[^A-Za-z0-9._-]", "_")
    return F.when(suffix(clean).isin(*(SIDECAR_SUFFIXES if sidecar else SUFFIXES)) & ~F.startswith(clean, F.lit(".")), clean)


def artifact_id(root: Column, relative: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", root, relative), 256), 1, 24)


def artifact_stage(relative: Column) -> Column:
    """struct<stage, category> by the file's name and folders; the first rule that fits."""
    path = F.lower(F.replace(relative, F.lit("\\"), F.lit("/")))
    name = file_name(path)
    has = lambda where, *parts: F.coalesce(*(F.when(F.contains(where, F.lit(p)), True) for p in parts), F.lit(False))
    rules = (  # fixed values of the interface, in their order: names and folders, stage, category
        (F.startswith(name, F.lit("stage_01_")) | F.startswith(name, F.lit("bbox_overlap_meta")) | has(path, "/georeferenced/", "/harmonized/") | has(name, "iirs_selected_band"), "stage_1", "harmonization"),
        (has(name, "coarse_alignment"), "stage_2", "coarse_alignment"),
        (has(path, "match_visualizations", "tile_pngs") | has(name, "matches") | name.isin("subpixel_tie_points.csv", "tie_points_inliers.csv", "hybrid_transform_model.json"), "stage_3", "matching"),
        (F.startswith(name, F.lit("registered_")) | has(name, "warp_composite_overlay"), "stage_4", "warping"),
        (has(name, "heatmap") | name.isin("verification_metrics.json", "registration_verification.png", "overview_side_by_side.png", "overview_false_color.png"), "stage_5", "verification"),
        (has(name, "preview", "sidebyside", "falsecolor"), "stage_4", "preview"),
    )
    pair = lambda a, b: F.struct(F.lit(a).alias("stage"), F.lit(b).alias("category"))
    return F.coalesce(*(F.when(test, pair(a, b)) for test, a, b in rules), pair("pipeline", "intermediate"))


def manifest(files: DataFrame, job_id: str) -> DataFrame:
    """Artifacts of files (root, relative, size_bytes): hidden files are skipped; ids, stages, previews and links are derived."""
    name, path = file_name(F.col("relative")), F.lower("relative")
    low = F.lower(name)
    bounded = F.startswith(low, F.lit("stage_01_")) | F.endswith(low, F.lit("_preview.png")) | low.isin("warp_composite_overlay.png", "registration_verification.png", "difference_heatmap.png", "overview_side_by_side.png", "overview_false_color.png")
    of_match = F.contains(path, F.lit("match_visualizations")) | F.contains(low, F.lit("matches"))
    named = files.where(~F.startswith(name, F.lit("."))).withColumns({"file_name": name, "artifact_id": artifact_id(F.col("root"), F.col("relative")), "rule": artifact_stage(F.col("relative"))})
    shown = suffix(F.col("file_name")).isin(".png", ".jpg", ".jpeg") & F.when(F.col("rule.stage") == "stage_3", of_match).otherwise(bounded) & (F.col("size_bytes") <= MOST_PREVIEW_BYTES)
    base = F.concat(F.lit(f"/api/v1/jobs/{job_id}/artifacts/"), F.col("artifact_id"))
    out = named.select("artifact_id", "file_name", "relative", F.col("rule.stage").alias("stage"), F.col("rule.category").alias("category"), "size_bytes", shown.alias("previewable"), F.concat(base, F.lit("/download")).alias("download_url"), F.when(shown, F.concat(base, F.lit("/preview"))).alias("preview_url"))
    return out.orderBy("stage", F.lower("relative"))


def artifact(of: DataFrame, wanted: str) -> DataFrame:
    """The artifact with an id, of a manifest; none if it has none."""
    return of.where(F.col("artifact_id") == wanted)


def filtered(of: DataFrame, stage: str | None = None, previewable: bool = False) -> DataFrame:
    """A manifest's artifacts of a stage, or those that can be previewed, or both."""
    out = of if stage is None else of.where(F.col("stage") == stage)
    return out.where("previewable") if previewable else out


def stage_totals(of: DataFrame) -> DataFrame:
    """(stage, n, n_previewable, bytes) of a manifest."""
    return of.groupBy("stage").agg(F.count("*").alias("n"), F.count_if("previewable").alias("n_previewable"), F.sum("size_bytes").alias("bytes"))


def primary_file(files: DataFrame, by: str, order: str = "idx") -> DataFrame:
    """Each group's primary file: a label or image before raw data before anything else; the first of its kind."""
    s = suffix(F.col("name"))
    kind = F.when(s.isin(".xml", ".lbl", ".tif", ".tiff"), 0).when(s.isin(".img", ".h5", ".hdf5"), 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy(by).orderBy(kind, order))
    return files.withColumn("is_primary", first == 1)


def stripped(path: Column) -> Column:
    """A path without its folders, for reports that leave the machine."""
    return file_name(path)


def existing_outputs(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links (job_id, file_type, path) whose file exists, as urls."""
    held = links.join(files.select("path").distinct(), "path", "left_semi").where(F.col("file_type").isin(*DOWNLOADS))
    return held.select("job_id", "file_type", F.concat(F.lit("/api/v1/downloads/"), F.col("job_id").cast("string"), F.lit("/"), F.col("file_type")).alias("url"))
