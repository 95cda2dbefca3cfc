"""Readers for navigation and label files, as DataFrames of one schema each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deepledger.functions.geo import utm_inverse
from deepledger.functions.text import number, timestamp, unix_timestamp

#: Names under which a field may appear, best first.
ALIASES = {
    "ts": ("timestamp", "time", "utc", "iso_time", "datetime", "gps_time"),
    "latitude": ("lat", "latitude", "lat_deg", "y"),
    "longitude": ("lon", "lng", "long", "longitude", "lon_deg", "x"),
    "heading_deg": ("heading", "hdg", "course", "cog", "heading_deg", "true_heading"),
    "altitude_m": ("altitude", "alt", "altitude_m", "depth", "sonar_depth", "fish_depth"),
    "accuracy_m": ("accuracy", "accuracy_m", "gps_accuracy", "hdop"),
    "source": ("source", "gps_source", "receiver"),
    "roll": ("roll", "roll_deg"),
    "pitch": ("pitch", "pitch_deg"),
    "heave": ("heave", "heave_m"),
    "towfish_x": ("towfish_x", "fish_x", "offset_x"),
    "towfish_y": ("towfish_y", "fish_y", "offset_y"),
    "towfish_z": ("towfish_z", "fish_z", "offset_z"),
    "layback": ("layback", "layback_m"),
}
NUMBERS = ("heading_deg", "altitude_m", "accuracy_m", "roll", "pitch", "heave", "towfish_x", "towfish_y", "towfish_z", "layback")


def aliased(columns: list[str]) -> dict[str, str]:
    """Which column holds each field: the first alias that a column's trimmed lower-case name equals. The projection is in the first column of the name crs or ending in .crs."""
    names = {c.strip().lower().lstrip("﻿"): c for c in reversed(columns)}
    found = {field: names[a] for field, options in ALIASES.items() for a in [next((o for o in options if o in names), None)] if a}
    crs = next((c for c in columns if re.fullmatch(r"(.*\.)?crs", c.strip().lower().lstrip("﻿"))), None)
    return found | ({"crs": crs} if crs is not None else {})


def to_wgs84(x: Column, y: Column, crs: Column) -> Column:
    """struct(lat, lon): as they are without a crs or with WGS84, by the inverse series for UTM names, null for others."""
    c = F.upper(F.coalesce(crs, F.lit("")))
    epsg = F.regexp_extract(c, r"(32[67])(\d{2})$", 2).try_cast("int")
    zone = F.coalesce(epsg, F.regexp_extract(c, r"UTM\s*(?:ZONE\s*)?(\d{1,2})\s*([NS])$", 1).try_cast("int"))
    south = (F.regexp_extract(c, r"(32[67])\d{2}$", 1) == "327") | c.rlike(r"UTM\s*(?:ZONE\s*)?\d{1,2}\s*S$")
    plain = (c == "") | c.rlike("(4326|WGS ?84|CRS84)$")
    same = F.struct(y.alias("lat"), x.alias("lon"))
    return F.when(plain, same).when(zone.between(1, 60), utm_inverse(x, y, zone, south))


def _record(rows: DataFrame, fields: dict[str, Column], also: tuple = ()) -> DataFrame:
    get = lambda k: fields.get(k, F.lit(None).cast("string"))
    when = fields.get("ts_value", F.lit(None).cast("timestamp"))
    flat = rows.select(*also, F.coalesce(when, timestamp(get("ts"))).alias("ts"), number(get("longitude")).alias("_x"), number(get("latitude")).alias("_y"), get("crs").alias("_crs"), *[number(get(k)).alias(k) for k in NUMBERS], F.nullif(F.trim(get("source")), F.lit("")).alias("source"))
    spot = flat.withColumn("_spot", to_wgs84(F.col("_x"), F.col("_y"), F.col("_crs")))  # in steps of their own, so that the long series is generated once
    return spot.select(*also, "ts", F.col("_spot.lat").alias("latitude"), F.col("_spot.lon").alias("longitude"), *NUMBERS, "source")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of CSV files with a header. Without latitude and longitude columns there are none."""
    rows = spark.read.csv(path, header=True)
    found = aliased(rows.columns)
    out = _record(rows, {k: F.col(f"`{c}`") for k, c in found.items()})
    return out if {"latitude", "longitude"} <= set(found) else out.limit(0)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of the Point features of GeoJSON documents, whose properties may be named in any of the ways of a CSV."""
    one = "struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>"
    schema = f"type string, crs struct<properties:struct<name:string>>, features array<{one}>, geometry struct<type:string,coordinates:array<double>>, properties map<string,string>, coordinates array<double>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    single = F.struct(F.lit("Feature").alias("type"), F.coalesce("geometry", F.struct(F.col("type"), F.col("coordinates"))).alias("geometry"), F.col("properties").alias("properties"))
    rows = docs.select(F.col("crs.properties.name").alias("crs"), F.explode(F.coalesce("features", F.array(single))).alias("f"))
    rows = rows.where((F.col("f.geometry.type") == "Point") & (F.size("f.geometry.coordinates") >= 2)).withColumn("p", F.transform_keys(F.coalesce("f.properties", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)))
    prop = lambda k: F.coalesce(*[F.try_element_at("p", F.lit(a)) for a in ALIASES[k]])
    fields = {k: prop(k) for k in ALIASES if k not in ("latitude", "longitude")}
    fields["ts_value"] = unix_timestamp(number(fields["ts"]))
    fields |= {"longitude": F.col("f.geometry.coordinates")[0].cast("string"), "latitude": F.col("f.geometry.coordinates")[1].cast("string"), "crs": F.col("crs")}
    return _record(rows, fields)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of GPX files: track points, route points and way points together."""
    schema = "_lat string, _lon string, _course string, _heading string, ele string, time string, course string"
    parts = [spark.read.format("xml").options(rowTag=tag, ignoreNamespace=True).schema(schema).load(path) for tag in ("trkpt", "rtept", "wpt")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _record(rows, {"ts": F.col("time"), "latitude": F.col("_lat"), "longitude": F.col("_lon"), "altitude_m": F.col("ele"), "heading_deg": F.coalesce("course", "_course", "_heading")})


READERS = {"csv": read_csv, "txt": read_csv, "geojson": read_geojson, "json": read_geojson, "gpx": read_gpx}


def read_navigation(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of files whose extension names their format."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for .{kind}: use {', '.join(READERS)}")
    return READERS[kind](spark, path)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(image, line): non-empty lines of label files; image is the file's stem."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return spark.read.text(path).select(stem.alias("image"), F.trim("value").alias("line")).where("line != ''")


def read_voc_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, y, w, h) of the objects of VOC annotation files, with corners or with width and height."""
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double,x:double,y:double,w:double,h:double>"
    rows = spark.read.format("xml").options(rowTag="object").schema(f"name string, bndbox {box}").load(path)
    b = lambda c: F.col(f"bndbox.{c}")
    return rows.select(F.trim("name").alias("name"), F.coalesce(b("x"), b("xmin")).alias("x"), F.coalesce(b("y"), b("ymin")).alias("y"), F.coalesce(b("w"), b("xmax") - b("xmin")).alias("w"), F.coalesce(b("h"), b("ymax") - b("ymin")).alias("h"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, images, truths, has_truth) of dataset manifests; unreadable ones are skipped."""
    schema = "id string, name string, images array<string>, ground_truth array<struct<image:string,boxes:array<struct<x:double,y:double,w:double,h:double,class:string>>>>, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True, mode="PERMISSIVE").where("_bad is null and id is not null")
    return rows.select("id", "name", F.coalesce(F.size("images"), F.lit(0)).alias("images"), F.coalesce(F.size("ground_truth"), F.lit(0)).alias("truths"), F.exists(F.coalesce("ground_truth", F.expr("cast(array() as array<struct<image:string,boxes:array<struct<x:double,y:double,w:double,h:double,class:string>>>>)")), lambda g: F.size(g["boxes"]) > 0).alias("has_truth"))
