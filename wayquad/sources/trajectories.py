"""Trajectories from the events table and from text, and back to text."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: File suffixes and the format they stand for (fixed values).
FORMATS = {".txt": "txt", ".csv": "txt", ".geojson": "geojson", ".geojsonl": "geojson", ".json": "geojson", ".wkt": "wkt"}


def format_of(path: str) -> str:
    """The text format by the file's suffix; ``part-*`` files hold raw records, unknown suffixes are read as txt with a warning."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.startswith("part-"):
        return "raw"
    found = next((f for s, f in FORMATS.items() if name.endswith(s)), None)
    if found is None:
        warnings.warn(f"unknown suffix of {path}: read as txt", stacklevel=2)
    return found or "txt"


def event_points(spark: SparkSession, sf_dir: str, chunk: int = 3) -> DataFrame:
    """(tid, seq, x, y): each user's events in chunks of three; x is hours since 2024, y the value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.expr("(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP'2024-01-01')) / 3.6E9D")
    numbered = events.select("user_id", x.alias("x"), F.col("value").alias("y"), (F.row_number().over(order) - 1).alias("rn"))
    return numbered.select((F.col("user_id") * 1000 + F.floor(F.col("rn") / chunk)).cast("long").alias("tid"), (F.col("rn") % chunk).cast("int").alias("seq"), "x", "y")


def from_points(points: DataFrame) -> DataFrame:
    """(tid, points) of trajectories with two points at least."""
    listed = points.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).where("size(p) >= 2")
    return listed.select("tid", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_points(event_points(spark, sf_dir))


def _pairs(parts: Column, separator: str) -> Column:
    """Points of texts 'x<separator>y...'; numbers that cannot be read are null."""
    return F.transform(parts, lambda p: F.struct(F.get(F.split(F.trim(p), separator), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(F.trim(p), separator), F.lit(1)).try_cast("double").alias("y")))


def _place(place: Column | None) -> list[Column]:
    return [] if place is None else [place.alias("place")]


def _sound(points: str) -> Column:
    return ~F.exists(points, lambda p: p["x"].isNull() | p["y"].isNull())


def parse_txt(lines: DataFrame, place: Column | None = None) -> DataFrame:
    """``tid|oid|seg|x,y;x,y...``: rows with a bad number or fewer than two points fall out."""
    f = F.split("value", r"\|")
    parts = F.filter(F.split(F.get(f, F.lit(3)), ";"), lambda p: F.trim(p) != "")
    cut = lines.where(F.size(f) >= 4).select(F.get(f, F.lit(0)).try_cast("long").alias("tid"), F.get(f, F.lit(1)).alias("oid"), F.get(f, F.lit(2)).alias("seg"), _pairs(parts, ",").alias("points"), *_place(place))
    return cut.where(F.col("tid").isNotNull() & (F.size("points") >= 2) & _sound("points"))


def parse_geojson(lines: DataFrame, place: Column | None = None) -> DataFrame:
    """One feature a line; the first two coordinates of a position count, the number of points is free."""
    kind = "STRUCT<properties: STRUCT<tid: BIGINT, oid: STRING, sid: STRING>, geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<DOUBLE>>>>"
    g = lines.select(F.from_json("value", kind).alias("g"), *_place(place)).where("g.properties.tid IS NOT NULL AND g.geometry.coordinates IS NOT NULL")
    points = F.transform("g.geometry.coordinates", lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))
    return g.select(F.col("g.properties.tid").alias("tid"), F.col("g.properties.oid").alias("oid"), F.col("g.properties.sid").alias("seg"), points.alias("points"), *(["place"] if place is not None else []))


def parse_wkt(lines: DataFrame, place: Column | None = None) -> DataFrame:
    """``tid,oid,seg,LINESTRING(x y, ...)``: the text between the first brackets."""
    f = F.split("value", ",", 4)
    inside = F.regexp_extract(F.get(f, F.lit(3)), r"\(([^)]*)", 1)
    cut = lines.where(F.size(f) >= 4).select(F.get(f, F.lit(0)).try_cast("long").alias("tid"), F.get(f, F.lit(1)).alias("oid"), F.get(f, F.lit(2)).alias("seg"), _pairs(F.split(inside, ","), r"\s+").alias("points"), *_place(place))
    return cut.where(F.col("tid").isNotNull() & _sound("points"))


def name_hash(name: str) -> Column:
    """md5 of a text as a number, modulo 10^9, by its 32 hexadecimal digits."""
    return F.expr(f"aggregate(sequence(1, 32), 0L, (a, i) -> (a * 16 + CAST(conv(substr(md5({name}), i, 1), 16, 10) AS BIGINT)) % 1000000000L)")


def parse_raw(lines: DataFrame, place: Column | None = None) -> DataFrame:
    """``a-b_c-MULTIPOINT Z((x y t), ...)``: tid is a hash of ``a-b_c``; bad numbers are skipped; two points at least."""
    head = r"^\s*(\d+)-(\d+)_(\d+)-MULTIPOINT"
    name = F.concat(F.regexp_extract("value", head, 1), F.lit("-"), F.regexp_extract("value", head, 2), F.lit("_"), F.regexp_extract("value", head, 3))
    triples = F.regexp_extract_all("value", F.lit(r"\(\s*([^\s()]+\s+[^\s()]+)(?:\s+[^\s()]+)?\s*\)"), 1)
    cut = lines.where(F.col("value").rlike(head)).select(name.alias("oid"), F.filter(_pairs(triples, r"\s+"), lambda p: p["x"].isNotNull() & p["y"].isNotNull()).alias("points"), *_place(place))
    return cut.where("size(points) >= 2").select(name_hash("oid").alias("tid"), "oid", "points", *(["place"] if place is not None else []))


def parse_taxi(lines: DataFrame) -> DataFrame:
    """``[tid,[["time",x,y],...]]`` with or without quotes around tid."""
    oid = F.regexp_extract("value", r'^\s*\[\s*"?([^",\[]+?)"?\s*,', 1)
    triples = F.regexp_extract_all("value", F.lit(r'\[\s*"[^"]*"\s*,\s*([-+0-9.eE]+\s*,\s*[-+0-9.eE]+)\s*\]'), 1)
    cut = lines.select(oid.alias("oid"), F.filter(_pairs(triples, r"\s*,\s*"), lambda p: p["x"].isNotNull() & p["y"].isNotNull()).alias("points"))
    return cut.where("oid <> '' AND size(points) >= 2")


#: Formats of times in text (fixed values); a time alone is one of the day 1900-01-01.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "HH:mm:ss", "yyyyMMddHHmmss")
#: The largest number of seconds that a timestamp holds.
LAST_SECOND = 253402300799


def parse_time(value: Column) -> Column:
    """A time in one of the formats, or unix seconds above 10^9; '', '0' and others are null.

    Days, months and hours may have one digit; a fraction has one to six.
    """
    n = lambda k: f"\\d{{1,{k}}}"
    clock = f"({n(2)}):({n(2)}):({n(2)})"
    fraction = "(?:\\.(\\d{1,6}))?"
    part = lambda pattern, *order: [F.regexp_extract(value, f"^{pattern}$", k) for k in order]

    def at(year: Column | str, month: Column | str, day: Column | str, hour: Column, minute: Column, second: Column, micros: Column | None = None) -> Column:
        date = [F.lit(x) if isinstance(x, str) else x for x in (year, month, day)]
        text = F.concat(F.concat_ws("-", F.lpad(date[0], 4, "0"), F.lpad(date[1], 2, "0"), F.lpad(date[2], 2, "0")), F.lit(" "), F.concat_ws(":", *(F.lpad(x, 2, "0") for x in (hour, minute, second))))
        whole = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
        return whole if micros is None else F.timestamp_micros(F.unix_micros(whole) + F.rpad(F.coalesce(F.nullif(micros, F.lit("")), F.lit("0")), 6, "0").cast("long"))

    dashed = f"(\\d{{4}})-({n(2)})-({n(2)}) {clock}{fraction}"
    slashed, day_first = f"(\\d{{4}})/({n(2)})/({n(2)}) {clock}", f"({n(2)})/({n(2)})/(\\d{{4}}) {clock}"
    dense = "(\\d{4})(\\d{2})(\\d{2})(\\d{2})(\\d{2})(\\d{2})"
    y, m, d, h, mi, s, f = part(dashed, *range(1, 8))
    formats = [
        F.when(value.rlike(f"^{dashed}$"), at(y, m, d, h, mi, s, f)),
        F.when(value.rlike(f"^{slashed}$"), at(*part(slashed, *range(1, 7)))),
        F.when(value.rlike(f"^{day_first}$"), at(*part(day_first, 3, 2, 1, 4, 5, 6))),
        F.when(value.rlike(f"^{clock}$"), at("1900", "1", "1", *part(clock, 1, 2, 3))),
        F.when(value.rlike(f"^{dense}$"), at(*part(dense, *range(1, 7)))),
    ]
    seconds = value.try_cast("double")
    return F.when(value != "0", F.coalesce(*formats, F.when((seconds > 1e9) & (seconds <= LAST_SECOND), F.timestamp_micros((seconds * 1000000).cast("long")))))


def numbers(points: str, between: str, after: str) -> Column:
    """Points as text: ``x<between>y`` joined by ``after``."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(between, p["x"].cast("string"), p["y"].cast("string"))), after)


def to_lines(rows: DataFrame, kind: str) -> DataFrame:
    """(tid, points) as lines of text: txt, geojson, wkt or raw; without columns oid and seg, oid is the tid and seg is 0."""
    tid = F.col("tid").cast("string")
    oid = F.coalesce(F.col("oid").cast("string"), tid) if "oid" in rows.columns else tid
    seg = F.coalesce(F.col("seg").cast("string"), F.lit("0")) if "seg" in rows.columns else F.lit("0")
    if kind == "txt":
        line = F.concat_ws("|", tid, oid, seg, numbers("points", ",", ";"))
    elif kind == "wkt":
        line = F.concat(F.concat_ws(",", tid, oid, seg, F.lit("LINESTRING(")), numbers("points", " ", ", "), F.lit(")"))
    elif kind == "raw":
        line = F.concat(oid, F.lit("-"), oid, F.lit("_"), seg, F.lit("-MULTIPOINT Z(("), numbers("points", " ", " 0), ("), F.lit(" 0))"))
    elif kind == "geojson":
        coordinates = F.transform("points", lambda p: F.array(p["x"], p["y"]))
        line = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("tid", oid.alias("oid"), seg.alias("sid")).alias("properties"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry")))
    else:
        raise ValueError(f"unknown format {kind}")
    return rows.select(line.alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Parse a text file or folder by its suffix; ``part-*`` files hold raw records.

    A path without files is an error of the reader; a folder of ``part-*`` files is read by ``folder/part-*``.
    """
    return PARSERS[format_of(path)](spark.read.text(path))


def read_first(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The first ``limit`` valid rows in the order of files and lines."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("line", F.monotonically_increasing_id())
    place = F.struct("file_path", "file_block_start", "line")
    kept = PARSERS[format_of(path)](lines, place=place)
    return kept.orderBy("place").limit(limit).drop("place")


def read_or_make(spark: SparkSession, path: str | None, n: int, box: tuple[float, float, float, float]) -> DataFrame:
    """(tid, points) of a data set, or ``n`` synthetic walks where there is no path or no valid row."""
    from wayquad.operators.augment import synthetic

    if path:
        rows = read_lines(spark, path).select("tid", "points")
        if rows.limit(1).count():
            return rows
    return synthetic(spark, n, box)


PARSERS = {"txt": parse_txt, "geojson": parse_geojson, "wkt": parse_wkt, "raw": parse_raw}


def identifier(line: str = "value") -> Column:
    """struct(oid, seg) of a raw record, ('unknown', 0) where it has no head."""
    head = r"^\s*(\d+)-(\d+)_(\d+)-MULTIPOINT"
    return F.when(F.col(line).rlike(head), F.struct(F.regexp_extract(line, head, 1).alias("oid"), F.regexp_extract(line, head, 3).cast("long").alias("seg"))).otherwise(F.struct(F.lit("unknown").alias("oid"), F.lit(0).cast("long").alias("seg")))


def scan_queries(lines: DataFrame) -> DataFrame:
    """Boxes of text lines that hold queries separated by ';'; those with fewer than four numbers fall out."""
    each = lines.select(F.explode(F.split("value", ";")).alias("query"), F.lit(None).cast("long").alias("range_meters"))
    return parse_queries(each).drop("range_meters")


def join_queries(boxes: DataFrame, key: str = "query_id") -> DataFrame:
    """All boxes of a (small) query set as one line, separated by ';', in the order of ``key``."""
    text = F.concat_ws(", ", *(F.format_string("%.6f", F.col(c).cast("double")) for c in ("min_x", "min_y", "max_x", "max_y")))
    return boxes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text.alias("t")))), lambda s: s["t"]), ";").alias("value"))


def sample_queries(items: DataFrame, ratio: float, key: str = "query") -> DataFrame:
    """A share of the queries, those with the smallest md5 of ``key``: the same at any partitioning."""
    return items.orderBy(F.md5(F.col(key).cast("string")), key).limit(max(0, int(items.count() * ratio)))


def parse_queries(items: DataFrame) -> DataFrame:
    """(query, range_meters) items with 'x1, y1, x2, y2' texts as boxes; items with fewer numbers fall out."""
    n = F.transform(F.split("query", ","), lambda p: F.trim(p).try_cast("double"))
    cut = items.select("range_meters", n.alias("n")).where("size(n) >= 4 AND NOT exists(slice(n, 1, 4), v -> v IS NULL)")
    return cut.selectExpr("range_meters", "n[0] AS min_x", "n[1] AS min_y", "n[2] AS max_x", "n[3] AS max_y")
