"""A Spark data source of navigation files of mixed formats: a partition a file, read where the task runs, and a reason for each file without records."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from deepledger.functions.text import number, unix_timestamp
from deepledger.sources.files import ALIASES, _record, aliased

#: The format of each extension, and what is said of a file that yields nothing.
FORMATS = {"csv": "csv", "txt": "csv", "geojson": "geojson", "json": "geojson", "gpx": "gpx"}
REASONS = {
    "csv": "no usable lat/lon columns found in CSV",
    "geojson": "no Point features found in GeoJSON",
    "gpx": "no trkpt/rtept/wpt elements found in GPX",
    None: "unsupported navigation file (use CSV, GeoJSON or GPX)",
}
RAW = "file string, format string, position long, fields map<string,string>, reason string"
POINTS = ("trkpt", "rtept", "wpt")


def _text(handle) -> io.TextIOWrapper:
    return io.TextIOWrapper(handle, encoding="utf-8-sig", errors="replace", newline="")


def csv_records(open_) -> Iterator[dict]:
    """The fields of each line of a file with a header; none without columns of latitude and longitude."""
    csv.field_size_limit(2**31 - 1)
    with _text(open_()) as lines:
        rows = csv.reader(line.replace("\0", "") for line in lines)
        header = next(rows, [])
        found = aliased(header)
        if {"latitude", "longitude"} <= set(found):
            at = {field: header.index(name) for field, name in found.items()}
            for row in rows:
                if row:
                    yield {field: row[i] for field, i in at.items() if i < len(row)}


def _features(documents: Iterator[object]) -> Iterator[dict]:
    for doc in documents:
        if not isinstance(doc, dict):
            continue
        crs = ((doc.get("crs") or {}).get("properties") or {}).get("name") if isinstance(doc.get("crs"), dict) else None
        features = doc.get("features") if isinstance(doc.get("features"), list) else [doc if "geometry" in doc else {"geometry": doc}]
        for feature in features:
            geometry = feature.get("geometry") if isinstance(feature, dict) else None
            spot = geometry.get("coordinates") if isinstance(geometry, dict) and geometry.get("type") == "Point" else None
            if not isinstance(spot, list) or len(spot) < 2:
                continue
            props = feature.get("properties") if isinstance(feature.get("properties"), dict) else {}
            low = {str(k).lower(): v for k, v in reversed(list(props.items())) if v is not None}
            fields = {field: next((low[a] for a in names if a in low), None) for field, names in ALIASES.items()}
            yield {k: v if isinstance(v, str) else json.dumps(v) for k, v in {**fields, "longitude": spot[0], "latitude": spot[1], "crs": crs}.items() if v is not None}


def geojson_records(open_) -> Iterator[dict]:
    """The Point features of one document, which is held whole, or of one document a line. A document that cannot be parsed ends a file without records."""
    with _text(open_()) as lines:
        first = next((line for line in lines if line.strip()), "")
    try:
        json.loads(first)
        with _text(open_()) as lines:  # all lines are looked at before the first is given
            for line in lines:
                if line.strip():
                    json.loads(line)
        by_line = True
    except ValueError:
        by_line = False
    try:
        with _text(open_()) as lines:
            yield from _features((json.loads(line) for line in lines if line.strip()) if by_line else iter([json.load(lines)]))
    except ValueError:
        return


def gpx_records(open_) -> Iterator[dict]:
    """Track, route and way points. The whole file is parsed once before the first is given, so that a broken one gives none."""
    try:
        with open_() as handle:
            for _, element in ElementTree.iterparse(handle):
                element.clear()
    except ElementTree.ParseError:
        return
    name = lambda element: element.tag.rsplit("}", 1)[-1]
    with open_() as handle:
        for _, element in ElementTree.iterparse(handle):
            if name(element) in POINTS:
                inner = {name(child): (child.text or "").strip() for child in element}
                if element.get("lat") is not None and element.get("lon") is not None:
                    heading = inner.get("course") or element.get("course") or element.get("heading")
                    fields = {"latitude": element.get("lat"), "longitude": element.get("lon"), "ts": inner.get("time"), "altitude_m": inner.get("ele"), "heading_deg": heading, "source": "gpx", "speed": inner.get("speed")}
                    yield {k: v for k, v in fields.items() if v}
            if name(element) in (*POINTS, "trkseg", "trk", "rte"):
                element.clear()


PARSERS = {"csv": csv_records, "geojson": geojson_records, "gpx": gpx_records}


def dispatched(name: str, open_) -> Iterator[tuple]:
    """Rows of RAW of one file: by its extension, else by its first byte GeoJSON where that gives points, then CSV; at least one row, which may hold a reason alone."""
    kind = FORMATS.get(name.rsplit(".", 1)[-1].lower()) if "." in name.rsplit("/", 1)[-1] else None
    options = [kind]
    if kind is None:
        with _text(open_()) as text:
            start = text.read(4096).lstrip()[:1]
        options = ["geojson", "csv"] if start in ("{", "[") else ["csv"]
    for option in options:
        position = -1
        for position, fields in enumerate(PARSERS[option](open_)):
            yield name, option, position, fields, None
        if position >= 0:
            return
    yield name, kind, None, None, REASONS[kind]


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        """The files below the path, whose names alone come to the driver; those that begin with . or _ are left out."""
        system, base = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(base)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
        hidden = lambda path: any(part[:1] in "._" for part in path[len(base) :].split("/") if part)
        return [_File(f.path) for f in found if f.is_file and not hidden(f.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None:  # what Spark passes where there are no files
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        yield from dispatched(partition.path, lambda: system.open_input_stream(partition.path, compression=None))


class NavigationFiles(DataSource):
    """`spark.read.format("navigation_files").load(uri)`: raw fields of navigation files as text."""

    @classmethod
    def name(cls) -> str:
        return "navigation_files"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_navigation_files(spark: SparkSession, uri: str) -> DataFrame:
    """Fixes of all navigation files below a folder, or of one file, with file, format, position (from 0) and warning.

    uri: an absolute path or a URI that every executor can read. Formats may be mixed and CSV files may have different headers. A
    file without a record gives one row with nulls and the reason as its warning; so does an empty file. A GPX point with a speed has
    a warning too, because metres a second are no accuracy. No files: no rows. Numbers of GeoJSON times are seconds since 1970.
    """
    spark.dataSource.register(NavigationFiles)
    raw = spark.read.format("navigation_files").load(uri)
    speed = F.try_element_at("fields", F.lit("speed"))
    warning = F.coalesce("reason", F.when(speed.isNotNull(), F.concat(F.lit("speed in m/s, not accuracy: "), speed)))
    flat = raw.select("file", "format", "position", warning.alias("warning"), *[F.try_element_at("fields", F.lit(k)).alias(f"_{k}") for k in (*ALIASES, "crs")])
    fields = {k: F.col(f"_{k}") for k in (*ALIASES, "crs")}
    fields["ts_value"] = F.when(F.col("format") == "geojson", unix_timestamp(number(fields["ts"])))
    return _record(flat, fields, ("file", "format", "position", "warning"))
