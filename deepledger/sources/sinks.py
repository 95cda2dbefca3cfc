"""Writers of reports and label files. Every one is a distributed write to a folder; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, by: str | None = None) -> None:
    """CSV files with a header; with `by`, in a folder for each of its values, as many files as tasks hold rows of it."""
    writer = rows.write.option("header", True).option("emptyValue", "")
    (writer.partitionBy(by) if by else writer).csv(path)


def write_documents(rows: DataFrame, path: str, column: str) -> None:
    """JSON documents or GeoJSON features of a string column, one a line; null ones are left out."""
    rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).write.text(path)


def write_label_files(labels: DataFrame, path: str) -> None:
    """The text of (image_id, lines) in a folder for each image."""
    labels.select("image_id", F.col("lines").alias("value")).write.partitionBy("image_id").text(path)


def write_manifests(divided: DataFrame, path: str) -> None:
    """The image ids of (image_id, split) in a folder for each split, one a line."""
    divided.select("split", F.col("image_id").cast("string").alias("value")).write.partitionBy("split").text(path)
