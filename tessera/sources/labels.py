"""Product labels, headers and footprint pages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import exposure_seconds

CORNERS = ("ul_lat", "ul_lon", "ur_lat", "ur_lon", "ll_lat", "ll_lon", "lr_lat", "lr_lon")
_LONG = {"u": "upper", "l": "lower"}
#: Pixel types by the keyword of a label's data type; the first that is part of it.
DATA_TYPES = (("unsignedmsb2", ">u2"), ("signedmsb2", ">i2"), ("unsignedlsb2", "<u2"), ("signedlsb2", "<i2"), ("ieee754msbsingle", ">f4"), ("ieee754lsbsingle", "<f4"), ("signedbyte", "i1"), ("unsignedbyte", "u1"))


def _tag(xml: Column, name: str) -> Column:
    """The text of the first element with a local name, whatever its namespace; null if there is none."""
    return F.nullif(F.trim(F.xpath_string(xml, F.lit(f"//*[local-name()='{name}'][1]"))), F.lit(""))


def _number(xml: Column, name: str) -> Column:
    return _tag(xml, name).try_cast("double")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml) of whole label files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def bounds(labels: DataFrame) -> DataFrame:
    """The eight corner values of each label; all null if any is missing."""
    xml, out = F.col("xml"), {}
    for corner in CORNERS:
        side, axis = corner.split("_")
        name = f"{_LONG[side[0]]}_{'left' if side[1] == 'l' else 'right'}_{'latitude' if axis == 'lat' else 'longitude'}"
        out[corner] = _number(xml, name)
    every = F.lit(True)
    for c in out.values():
        every = every & c.isNotNull()
    return labels.select(*[c for c in labels.columns if c != "xml"], *(F.when(every, c).alias(k) for k, c in out.items()))


def sensor(name: Column, angle: Column | None = None) -> Column:
    """The sensor by an instrument's name; the terrain camera's by its angle as well."""
    n = F.upper(name)
    side = F.upper(F.trim(angle)) if angle is not None else F.lit(None).cast("string")
    tmc = F.when(side.isin("FORE", "AFT"), F.concat(F.lit("TMC_"), side)).otherwise("TMC")
    return F.when(F.contains(n, F.lit("OHRC")), "OHRC").when(F.contains(n, F.lit("TMC")), tmc).when(F.contains(n, F.lit("IIRS")), "IIRS").otherwise(n)


def metadata(labels: DataFrame) -> DataFrame:
    """start, stop, exposure_s, sensor, lines, samples, offset and dtype of each label."""
    xml = F.col("xml")
    unit = F.xpath_string(xml, F.lit("//*[local-name()='line_exposure_duration']/@unit"))
    axis = lambda a: F.xpath_string(xml, F.lit(f"//*[local-name()='Axis_Array'][*[local-name()='axis_name']='{a}']/*[local-name()='elements']")).try_cast("int")
    name = F.xpath_string(xml, F.lit("//*[local-name()='Observing_System_Component'][1]/*[local-name()='name']"))
    time = lambda t: F.regexp_replace(_tag(xml, t), "Z$", "").try_cast("timestamp_ntz")
    keyword = F.lower(F.coalesce(_tag(xml, "data_type"), F.lit("")))
    dtype = F.lit(None).cast("string")
    for k, v in reversed(DATA_TYPES):
        dtype = F.when(F.contains(keyword, F.lit(k)), v).otherwise(dtype)
    return labels.select(
        *[c for c in labels.columns if c != "xml"], time("start_date_time").alias("start"), time("stop_date_time").alias("stop"),
        exposure_seconds(_number(xml, "line_exposure_duration"), unit).alias("exposure_s"), sensor(name, _tag(xml, "camera_angle")).alias("sensor"),
        axis("Line").alias("lines"), axis("Sample").alias("samples"), F.coalesce(_tag(xml, "offset").try_cast("long"), F.lit(0)).alias("offset"), F.coalesce(dtype, F.lit("u1")).alias("dtype"),
    )


#: Header keys with what stands for them where a header lacks them.
HEADER = {"RECORD_BYTES": 704, "LABEL_RECORDS": 10, "LINES": 0, "LINE_SAMPLES": 704, "LRO:NFRAMES": 0}


def header(lines: DataFrame, by: str, order: str, line: str = "line") -> DataFrame:
    """Fields of text headers with lines KEY = VALUE: of a key the first value that is a number; the mode's first value in upper
    case without quotes; frames from the lines if they aren't given."""
    key, value = F.regexp_extract(F.col(line), r"^\s*([A-Z:_^]+)\s*=", 1), F.trim(F.replace(F.regexp_extract(F.col(line), r"=\s*(.*?)\s*$", 1), F.lit('"'), F.lit("")))
    pairs = lines.select(by, order, key.alias("k"), value.alias("v")).where("k != ''")
    number = lambda k: F.min_by(F.col("v").try_cast("int"), F.when((F.col("k") == k) & F.col("v").try_cast("int").isNotNull(), F.col(order)))
    named = {"RECORD_BYTES": "record_bytes", "LABEL_RECORDS": "label_records", "LINES": "lines", "LINE_SAMPLES": "samples", "LRO:NFRAMES": "n_frames"}
    out = pairs.groupBy(by).agg(*(F.coalesce(number(k), F.lit(v)).alias(named[k]) for k, v in HEADER.items()), F.coalesce(F.upper(F.min_by("v", F.when(F.col("k") == "INSTRUMENT_MODE_ID", F.col(order)))), F.lit("COLOR")).alias("mode"))
    per_frame = F.when(F.col("mode") == "COLOR", 78).when(F.col("mode") == "VIS", 70).otherwise(14)
    return out.withColumns({"offset": F.col("label_records") * F.col("record_bytes"), "n_frames": F.when(F.col("n_frames") > 0, F.col("n_frames")).otherwise(F.floor(F.col("lines") / per_frame).cast("int"))})


def product_id(name: Column) -> Column:
    """A product's id from a file name: upper case, without folder, suffix and processing tail."""
    return F.regexp_extract(F.upper(F.regexp_extract(name, r"([^/\\]*)$", 1)), r"^([A-Z]\d+[A-Z]+)", 1)


def table_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a map of the pairs of neighbouring table cells in their HTML: a key cell, then its value."""
    cells = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<td[^>]*>\s*([^<]*?)\s*</td>"), F.lit(1))
    with_cells = pages.withColumn("__cells", cells)
    n = F.floor(F.size("__cells") / 2).cast("int")
    pairs = F.transform(F.slice("__cells", 1, n), lambda _, k: F.struct(F.lower(F.get("__cells", 2 * k)).alias("key"), F.get("__cells", 2 * k + 1).alias("value")))
    first = F.filter(pairs, lambda p, k: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == k + 1)
    return with_cells.withColumn("cells", F.map_from_entries(first)).drop("__cells")


def footprints(products: DataFrame, cache: DataFrame, scraped: DataFrame) -> DataFrame:
    """products (product_id) with the corners of a cache, or else of scraped pages (product_id, cells), or null."""
    from_page = scraped.select("product_id", *(F.try_element_at("cells", F.lit(c)).try_cast("double").alias(f"p_{c}") for c in CORNERS))
    held = products.join(cache.select("product_id", *CORNERS), "product_id", "left").join(from_page, "product_id", "left")
    return held.select(*products.columns, *(F.coalesce(c, f"p_{c}").alias(c) for c in CORNERS))


def first_valid_points(spark: SparkSession, paths: list[str], required=("src_x", "src_y", "ref_x", "ref_y"), least: int = 3) -> DataFrame | None:
    """The first of several tie-point files that can be read, has the columns and enough rows."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            df = spark.read.csv(path, header=True)
        except AnalysisException:
            continue
        if set(required) <= set(df.columns):
            points = df.select(*(F.col(c).try_cast("double").alias(c) for c in df.columns)).dropna(subset=list(required))
            if len(points.take(least)) == least:
                return points
    return None


def coverage(files: DataFrame) -> DataFrame:
    """Per kind of files (kind, start, stop): how many, and the earliest and latest time."""
    return files.groupBy("kind").agg(F.count("*").alias("n"), F.min("start").alias("earliest"), F.max("stop").alias("latest"))


def newest_first(df: DataFrame, by: str, order: Column) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(order.desc()))).where("rn = 1").drop("rn")
