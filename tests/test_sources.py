from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import footprints as G
from tessera.operators import jobs as J
from tessera.operators import rasters as R
from tessera.operators import tiles as T
from tessera.sources import labels as L
from tessera.sources import raw, sinks
from tessera.sources.buckets import BucketedTable
from tessera.streaming import telemetry

LABEL = """<Product xmlns="urn:a" xmlns:x="urn:b"><Observing_System><Observing_System_Component><name>OHRC camera</name></Observing_System_Component></Observing_System>
<Time_Coordinates><start_date_time>2021-03-31T20:33:24.3734Z</start_date_time><stop_date_time>2021-03-31T20:33:40.7571Z</stop_date_time></Time_Coordinates>
<x:line_exposure_duration unit="ms">181.740</x:line_exposure_duration>{corners}
<File_Area><Array_2D_Image><offset unit="byte">16</offset><Axis_Array><axis_name>Line</axis_name><elements>7</elements></Axis_Array><Axis_Array><axis_name>Sample</axis_name><elements>5</elements></Axis_Array>
<Element_Array><data_type>UnsignedLSB2</data_type></Element_Array></Array_2D_Image></File_Area></Product>"""
NAMES = [f"{v}_{h}_{a}" for v in ("upper", "lower") for h in ("left", "right") for a in ("latitude", "longitude")]


def test_labels(spark):
    full = "".join(f"<x:{n}>{k}.5</x:{n}>" for k, n in enumerate(NAMES))
    df = spark.createDataFrame([(1, LABEL.format(corners=full)), (2, LABEL.format(corners="")), (3, "<a/>")], "id int, xml string")
    b = {r["id"]: r for r in L.bounds(df).collect()}
    assert b[1]["ul_lat"] == 0.5 and b[1]["lr_lon"] == 7.5 and b[2]["ul_lat"] is None and b[3]["lr_lat"] is None
    m = {r["id"]: r for r in L.metadata(df).collect()}
    assert m[1]["sensor"] == "OHRC" and (m[1]["lines"], m[1]["samples"], m[1]["offset"], m[1]["dtype"]) == (7, 5, 16, "<u2")
    assert m[1]["exposure_s"] == pytest.approx(181.74e-6) and str(m[1]["start"]).startswith("2021-03-31 20:33:24.37")
    assert m[3]["dtype"] == "u1" and m[3]["lines"] is None


def test_raw_raster(spark, tmp_path):
    image = np.arange(7 * 5, dtype="<u2").reshape(7, 5)
    path = tmp_path / "a.img"
    path.write_bytes(b"\0" * 16 + image.tobytes())
    tiles = raw.load_raster(spark, str(path), {"lines": 7, "samples": 5, "offset": 16, "dtype": "<u2"})
    assert (T.array_of(tiles, 7, 5) == image).all()
    small = raw.read_raw(spark, f"file://{path}", lines=7, samples=5, offset=16, pixel_type="<u2", block_rows=3)
    assert small.count() == 6 and (T.array_of(small, 7, 5) == image).all()
    v = {(r["row"], r["col"]): r["v"] for r in raw.decimated(small, 2).collect()}
    assert v[0, 0] == pytest.approx(np.mean([1, 5, 6])) and v[3, 2] == 34
    with pytest.raises(ValueError):
        raw.load_raster(spark, str(path))
    with pytest.raises(Exception, match="too short"):
        raw.read_raw(spark, str(path), lines=99, samples=5).collect()


def test_sinks(spark, tmp_path):
    pts = spark.createDataFrame([(1.005, 2.0, 3.14159, 4.0)], "sx double, sy double, rx double, ry double")
    sinks.write_points(pts, f"{tmp_path}/p", 2)
    got = L.first_valid_points(spark, [f"{tmp_path}/none", f"{tmp_path}/p"], least=1).first()
    assert got["ref_x"] == 3.14
    assert L.first_valid_points(spark, [f"{tmp_path}/p"]) is None
    sinks.write_points(pts.limit(0), f"{tmp_path}/empty", 4)
    a = np.arange(600, dtype=np.uint8).reshape(20, 30)
    sinks.write_tiles(T.tiles_of(spark, "a", a, 8), f"{tmp_path}/tiles")
    window = sinks.read_window(spark, f"{tmp_path}/tiles", "a", 0, 0, 8, 8)
    assert window.count() == 1
    png, tiff = sinks.png(a), sinks.tiff(a)
    assert png[:4] == b"\x89PNG" and tiff[:4] == b"II*\0" and zlib.decompress(tiff[8 : 8 + len(zlib.compress(a.tobytes()))]) == a.tobytes()
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.upsert(spark, f"{tmp_path}/t", t, "id", 0)
    new = sinks.upsert(spark, f"{tmp_path}/t", spark.createDataFrame([(2, "c", 1.0)], "id int, v string, w double"), "id", 1)
    assert sorted(map(tuple, new.collect())) == [(1, "a", None), (2, "c", 1.0)]
    boards = sinks.dashboard(spark.createDataFrame([("r", 0.5)], "run_id string, rmse double"))
    assert boards["correspondence_evidence"].first()["rmse"] == 0.5 and boards["correspondence_evidence"].first()["hull"] is None


def test_footprint_pairs(spark):
    box = lambda rows: spark.createDataFrame(rows, "id int, left double, bottom double, right double, top double")
    a = box([(1, 0.0, 0.0, 10.0, 10.0), (2, 100.0, 100.0, 300.0, 300.0)])
    b = box([(1, 10.0, 0.0, 20.0, 10.0), (2, 2.0, 2.0, 3.0, 3.0), (3, 299.0, 299.0, 301.0, 301.0), (4, -5.0, -5.0, 500.0, 500.0)])
    got = {(r["a_id"], r["b_id"]): r for r in G.overlaps(a, b, 7.0).collect()}
    assert set(got) == {(1, 2), (1, 4), (2, 3), (2, 4)} and got[1, 2]["b_pct"] == pytest.approx(100)


def test_longitudes_keep_both_ends(spark):
    from tessera.functions.numeric import wrap_longitude

    df = spark.createDataFrame([(v,) for v in (180.0, -180.0, 180.5, -180.5, 540.0, 900.25)], "lon double")
    assert [r[0] for r in df.select(wrap_longitude(F.col("lon"))).collect()] == [180.0, -180.0, -179.5, 179.5, 180.0, 180.25 - 360]


def test_entropy_of_flat_and_few_values(spark):
    rows = [("flat", 7.0)] * 200 + [("few", float(k + 1)) for k in range(50)] + [("noise", float(v)) for v in np.random.default_rng(42).uniform(10, 200, 2500)]
    got = dict(map(tuple, R.histogram_entropy(spark.createDataFrame(rows, "band string, v double"), ["band"]).collect()))
    assert got["flat"] == 0 and got["few"] == 0 and got["noise"] > 3


def test_band_cube_picks_the_varied_band(spark):
    rng = np.random.default_rng(42)
    rows = [(b, float(v)) for b in range(10) for v in (rng.uniform(50, 250, 400) if b == 3 else np.full(400, 10.0 * b + 1))]
    top = R.band_scores(spark.createDataFrame(rows, "band int, v double"), "band", R.wavelength(F.col("band")), 689.0).where("rank = 1").first()
    assert top["band"] == 3


def test_push_frames(spark):
    lines = spark.range(78 * 3).select(F.col("id").alias("line"), F.lit(0).alias("sample"), F.col("id").cast("double").alias("v"))
    rows = R.deinterleave(lines, 7).orderBy("row").toPandas()
    assert rows.row.tolist() == list(range(42)) and rows.v.iloc[14] == 78 + 64
    assert R.deinterleave(lines, 415).count() == 42
    with pytest.raises(ValueError):
        R.deinterleave(lines, 7, "VIS")


@pytest.mark.parametrize("n", [39, 40, 41, 100])
def test_retention_batch_and_stream(spark, tmp_path, n):
    rows = spark.range(n).select(F.lit(1).cast("long").alias("job_id"), F.timestamp_seconds(F.col("id") / 3).cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("title"))
    assert telemetry.batch_retention(rows).count() == min(n, 40)
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    telemetry.retained_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert BucketedTable(spark, f"{tmp_path}/out", "job_id").read().count() == min(n, 40)


def test_streaming_state(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 3).alias("job_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("title"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = telemetry.streaming_state(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 10)
    q = stream.writeStream.outputMode("update").format("memory").queryName("job_states").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["job_id"]: r for r in spark.table("job_states").collect()}
    assert got[0]["title"] == "s99" and got[0]["n_kept"] == 10 and got[0]["n_seen"] == 34
    counts = telemetry.windowed_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = counts.writeStream.outputMode("append").format("memory").queryName("window_counts").trigger(availableNow=True).start()
    q.awaitTermination()


def test_jobs(spark):
    e = spark.createDataFrame([("a.PNG", 1), ("b.h5", 2), ("..", 3)], "name string, idx int")
    assert [r[0] for r in e.select(J.safe_name(F.col("name"))).collect()] == [None, "b.h5", None]
    jobs = spark.createDataFrame([(k,) for k in range(5)], "id int")
    total, page = J.page(jobs, [F.desc("id")], -3, 1000)
    assert total.first()[0] == 5 and page.count() == 5
    files = spark.createDataFrame([("output", "x/.h", 1), ("output", "x/a_preview.png", 9 * 1024**2), ("output", "x/b_preview.png", 5)], "root string, relative string, size_bytes long")
    got = {r["file_name"]: r for r in J.manifest(files, "j").collect()}
    assert set(got) == {"a_preview.png", "b_preview.png"} and not got["a_preview.png"]["previewable"] and got["b_preview.png"]["preview_url"].endswith("/preview")
