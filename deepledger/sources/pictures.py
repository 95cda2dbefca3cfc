"""Readers of image files, masks, crop indexes and EXIF fields. All are distributed scans; files are decoded in their own task."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags of EXIF directories, of the fields read, and the sizes of their types.
GPS_TAG, TAKEN_TAG, CHANGED_TAG = 34853, 36867, 306
GPS_LAT_REF, GPS_LAT, GPS_LON_REF, GPS_LON, GPS_ALT = 1, 2, 3, 4, 6
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
#: Weights of blue, green and red in a grey level, in 2**14 parts.
GREY_WEIGHTS, GREY_BITS = (1868, 9617, 4899), 14


def _decoded(spark: SparkSession, path: str, kernel) -> DataFrame:
    """(path, data, height, width) of image files; kernel takes the bytes of all channels, blue first, to those of one."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            data = [kernel(np.frombuffer(r.data, np.uint8).reshape(-1, r.channels)).astype(np.uint8).tobytes() if r.channels > 0 else None for r in rows.itertuples()]
            yield pd.DataFrame({"path": rows["path"], "data": data, "height": rows["height"].where(rows["channels"] > 0), "width": rows["width"].where(rows["channels"] > 0)})

    image = spark.read.format("image").load(path).select("image.*")
    return image.select(F.col("origin").alias("path"), "data", "height", "width", F.col("nChannels").alias("channels")).mapInPandas(work, "path string, data binary, height int, width int")


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[1] < 3:
        return pixels[:, 0]
    return (pixels[:, :3].astype(np.int64) @ np.array(GREY_WEIGHTS) + (1 << GREY_BITS - 1)) >> GREY_BITS


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, data, height, width) of image files of 8 bits a channel as 8-bit grey; data, height and width null if undecodable.

    Spark's decoder keeps the low byte of grey files of 16 bits; these are to be converted before.
    """
    return _decoded(spark, path, _grey)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(path, data, height, width): 1 where the first channel of a mask file is above 0, else 0."""
    return _decoded(spark, path, lambda pixels: pixels[:, 0] > 0)


def read_crop_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV indexes of crops, all columns as text."""
    return spark.read.option("header", True).csv(path)


def _directory(tiff: bytes, order: str, at: int) -> dict[int, list]:
    """The values of an EXIF directory by tag; entries of unknown types or outside the data are left out."""
    out = {}
    (count,) = struct.unpack_from(order + "H", tiff, at)
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * i)
        size = TYPE_SIZES.get(kind, 0) * n
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(order + "I", tiff, place)
        if not size or place + size > len(tiff):
            continue
        if kind in (1, 2, 7):
            out[tag] = [tiff[place : place + n].split(b"\0")[0].decode("latin-1")]
        elif kind in (5, 10):
            parts = struct.unpack_from(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", tiff, place)
            out[tag] = [a / b if b else float("nan") for a, b in zip(parts[::2], parts[1::2])]
        else:
            out[tag] = list(struct.unpack_from(f"{order}{n}{ {3: 'H', 4: 'I', 9: 'i'}[kind] }", tiff, place))
    return out


def _tiff_block(content: bytes) -> bytes | None:
    """The TIFF block of a JPEG, PNG or TIFF file."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size, kind = struct.unpack_from(">I4s", content, at)
            if kind == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        (size,) = struct.unpack_from(">H", content, at + 2)
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def exif_fields(content: bytes) -> tuple[float | None, float | None, float | None, str | None]:
    """lat, lon (7 decimals), altitude_m (2 decimals, above 0) and captured_at; null where absent, broken or out of range."""
    try:
        tiff = _tiff_block(content)
        if tiff is None:
            return None, None, None, None
        order = "<" if tiff[:2] == b"II" else ">"
        main = _directory(tiff, order, *struct.unpack_from(order + "I", tiff, 4))
    except struct.error:
        return None, None, None, None
    try:
        gps = _directory(tiff, order, main[GPS_TAG][0]) if GPS_TAG in main else {}
    except struct.error:
        gps = {}

    def degrees(value: int, ref: int, negative: str, most: float) -> float | None:
        if len(gps.get(value, ())) < 3 or not gps.get(ref, [""])[0]:
            return None
        d, m, s = gps[value][:3]
        x = (d + m / 60 + s / 3600) * (-1 if gps[ref][0].strip().upper() == negative else 1)
        return round(x, 7) if -most <= x <= most else None

    altitude = gps.get(GPS_ALT, [0.0])[0]
    taken = (main.get(TAKEN_TAG) or main.get(CHANGED_TAG) or [""])[0]
    return degrees(GPS_LAT, GPS_LAT_REF, "S", 90.0), degrees(GPS_LON, GPS_LON_REF, "W", 180.0), round(altitude, 2) if altitude > 0 else None, taken.strip() or None


def read_exif(spark: SparkSession, path: str) -> DataFrame:
    """(path, lat, lon, altitude_m, captured_at) of image files, one row a file."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = pd.DataFrame([exif_fields(c) for c in rows["content"]], columns=["lat", "lon", "altitude_m", "captured_at"], dtype=object)
            yield pd.concat([rows[["path"]].reset_index(drop=True), found], axis=1)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, "path string, lat double, lon double, altitude_m double, captured_at string")


def png(image: np.ndarray) -> bytes:
    """An 8-bit grey or (height, width, 3) red-green-blue image as a PNG file."""
    rows = image.astype(np.uint8).reshape(len(image), -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(np.pad(rows, [(0, 0), (1, 0)]).tobytes())) + chunk(b"IEND", b"")


def previews(images: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """(image_id, png) of (image_id, data, height, width), 8-bit grey: as it is, or in colour with a green frame, two pixels wide, around each of boxes (image_id, x, y, w, h)."""
    if boxes is None:
        rows = images.withColumn("boxes", F.expr("cast(null as array<struct<x:double,y:double,w:double,h:double>>)"))
    else:
        rows = images.join(boxes.groupBy("image_id").agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in "xywh"])).alias("boxes")), "image_id", "left")

    def draw(r) -> bytes:
        image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
        if r.boxes is None:
            return png(image)
        image = np.repeat(image[:, :, None], 3, axis=2)
        for b in r.boxes:
            x0, y0, x1, y1 = int(b["x"]), int(b["y"]), int(b["x"] + b["w"]), int(b["y"] + b["h"])
            outer, inner = np.zeros(image.shape[:2], bool), np.zeros(image.shape[:2], bool)
            outer[max(0, y0 - 1) : max(0, y1 + 1), max(0, x0 - 1) : max(0, x1 + 1)] = True
            inner[max(0, y0 + 1) : max(0, y1 - 1), max(0, x0 + 1) : max(0, x1 - 1)] = True
            image[outer & ~inner] = (0, 255, 0)
        return png(image)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"image_id": part["image_id"], "png": [draw(r) for r in part.itertuples()]})

    return rows.where("data is not null").select("image_id", "data", "height", "width", "boxes").mapInPandas(work, "image_id long, png binary")
