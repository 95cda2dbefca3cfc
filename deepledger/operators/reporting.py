"""Public projections, report parts, checks of inputs and orders of frames and classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deepledger.functions import scores
from deepledger.functions.text import location_status
from deepledger.operators import detections as D

#: Image types and the greatest size of an upload, in bytes.
IMAGE_TYPES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
MAX_UPLOAD = 50 * 1024 * 1024
#: Least and greatest value of each input of the location calculator, whether the least is itself excluded, and whether the input is required.
CALCULATOR = (
    ("latitude", -90, 90, False, True), ("longitude", -180, 180, False, True), ("heading_deg", 0, 360, False, True), ("altitude_m", 0, None, True, True),
    ("slant_range_m", 0, None, True, False), ("row", 0, None, False, False), ("image_height", 0, None, False, False), ("range_m", 0, None, True, False),
    ("layback_m", 0, None, False, False), ("roll_deg", -45, 45, False, False), ("pitch_deg", -45, 45, False, False), ("accuracy_m", 0, None, True, False),
)


def public_detections(detections: DataFrame) -> DataFrame:
    """What callers see of each detection: boxes to one decimal, scores to three, null evidence as the neutral 0.5, and its location's state.

    A location without a state of its own is approximate when there is one, else unknown.
    """
    rows = D.scored(detections)
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    own = F.when(F.col("location_status").isNotNull(), location_status(F.col("location_status"))) if "location_status" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.col("detection_id").alias("id"), F.coalesce("class_name", F.lit("debris")).alias("class"), *[F.round(c, 1).alias(f"bbox_{c}") for c in "xywh"],
        F.round("class_confidence", 3).alias("yolo_confidence"), F.round(scores.bell(F.col("mask_frac")), 3).alias("segmentation_score"), F.round(F.coalesce("natural", F.lit(0.5)), 3).alias("artificial_probability"),
        F.col("shadow").alias("shadow_score"), F.col("physics").alias("geometry_score"), F.col("fusion").alias("final_confidence"), F.col("status").alias("decision"),
        known.alias("known"), F.coalesce(own, F.when(known, "approximate").otherwise("unknown")).alias("location"), "lat", "lon", "uncertainty_m", "priority", "tier",
    )


def report_parts(surveys: DataFrame, frames: DataFrame, results: DataFrame, detections: DataFrame, targets: DataFrame) -> DataFrame:
    """(survey_id, part, part_id, body): what every form of report is made of, a JSON body a row, null fields kept.

    Parts are the survey, its images with their results (null without one), detections and targets. A survey's parts are rows,
    not one document, so that no survey has to fit a task; evidence of a target that is no JSON becomes null.
    """
    body = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"}).alias("body")
    part = lambda rows, name, key, *c: rows.select("survey_id", F.lit(name).alias("part"), F.col(key).cast("string").alias("part_id"), body(*c))
    found = results.select("image_id", F.struct(*[c for c in results.columns if c != "image_id"]).alias("result"))
    images = frames.join(found, "image_id", "left")
    evidence = F.get_json_object("evidence", "$").alias("evidence")
    return (
        part(surveys, "survey", "survey_id", *[c for c in surveys.columns if c != "survey_id"])
        .union(part(images, "image", "image_id", *[c for c in images.columns if c not in ("survey_id", "image_id")]))
        .union(part(detections, "detection", "detection_id", *[c for c in detections.columns if c not in ("survey_id", "detection_id")]))
        .union(part(targets, "target", "target_id", *[c for c in targets.columns if c not in ("survey_id", "target_id", "evidence")], evidence))
    )


def markdown_lines(detections: DataFrame) -> DataFrame:
    """(survey_id, line_no, line) of a Markdown report: a title, a line of counts, and a table of detections by priority.

    Lines are rows, so a writer may sort them within partitions of survey_id; the places of title and table head are fixed.
    """
    # totals and ranks are windows over the same shuffle; the first of a survey brings its head
    survey = Window.partitionBy("survey_id")
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rows = D.scored(detections).select("survey_id", "detection_id", "class_name", "status", "tier", "priority", known.alias("known"))
    ranked = rows.withColumns({
        "rank": F.row_number().over(survey.orderBy(F.desc("priority"), "detection_id")).cast("long"), "n": F.count("*").over(survey),
        "located": F.count_if("known").over(survey), "urgent": F.count_if(F.col("tier").isin("high", "critical")).over(survey),
    })
    head = F.array(
        F.concat(F.lit("# Survey "), F.col("survey_id")), F.format_string("%d detections, %d located, %d of high or critical priority", "n", "located", "urgent"),
        F.lit("| rank | detection | class | status | tier |"), F.lit("|---|---|---|---|---|"),
    )
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("rank").cast("string"), *[F.coalesce(F.col(c), F.lit("")) for c in ("detection_id", "class_name", "status", "tier")]), F.lit(" |"))
    numbered = lambda k, text: F.struct(k.cast("long").alias("line_no"), text.alias("line"))
    own = numbered(F.col("rank") + 3, line)
    lines = F.when(F.col("rank") == 1, F.concat(F.transform(head, lambda text, k: numbered(k, text)), F.array(own))).otherwise(F.array(own))
    return ranked.select("survey_id", F.inline(lines))


def target_uncertainty(targets: DataFrame, detections: DataFrame) -> DataFrame:
    """targets with the uncertainty_m of the detection that their evidence names as `from_detection_id`; null where either is unknown."""
    named = targets.withColumn("from_detection_id", F.get_json_object("evidence", "$.from_detection_id"))
    known = detections.select(F.col("detection_id").alias("from_detection_id"), "uncertainty_m")
    return named.join(known, "from_detection_id", "left")


def upload_fault(name: Column, size: Column) -> Column:
    """Why a file cannot be taken, else null: no name, a type that is no image, no content, or too much of it."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    typed = F.lit(False)
    for end in IMAGE_TYPES:
        typed = typed | lower.endswith(end)
    return F.when(lower == "", "file has no name").when(~typed, "unsupported file type").when(F.coalesce(size, F.lit(0)) == 0, "empty file").when(size > MAX_UPLOAD, "file exceeds 50 MB limit")


def calculator_faults(requests: DataFrame) -> Column:
    """Array of the inputs of a location request that are missing or outside their range, in order; NaN is outside."""
    faults = []
    for name, least, most, above, required in CALCULATOR:
        if name not in requests.columns:
            faults.append(F.lit(f"{name} missing" if required else None).cast("string"))
            continue
        value = F.col(name)
        good = (value > least) if above else (value >= least)
        good = good & ~F.isnan(value.cast("double")) & ((value <= most) if most is not None else F.lit(True))
        faults.append(F.when(value.isNull(), F.lit(f"{name} missing" if required else None)).when(~good, f"{name} out of range"))
    return F.array_compact(F.array(*faults))


def uniform_dimensions(frames: DataFrame) -> DataFrame:
    """(survey_id, uniform): whether all frames of a survey have one size; an unknown size is a size of its own."""
    size = F.struct(F.coalesce("width", F.lit(-1)).alias("w"), F.coalesce("height", F.lit(-1)).alias("h"))
    return frames.groupBy("survey_id").agg((F.min(size) == F.max(size)).alias("uniform"))


def ordered_frames(frames: DataFrame) -> DataFrame:
    """frames with their place in the survey by frame_index, nulls first, then file name."""
    order = Window.partitionBy("survey_id").orderBy(F.asc_nulls_first("frame_index"), F.asc_nulls_first("filename"), "image_id")
    return frames.withColumn("place", F.row_number().over(order))


def chronological_tail(frames: DataFrame, group: str, share: float = 0.85) -> DataFrame:
    """frames with `tail`: whether they come after the first floor(share x n) of their group by file name, so that the newest are held back."""
    sizes = frames.groupBy(group).agg(F.floor(F.count("*") * share).alias("head_rows"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("filename", "image_id"))
    return frames.withColumn("place", place).join(sizes, group).withColumn("tail", F.col("place") > F.col("head_rows")).drop("place", "head_rows")


def classes_by_count(detections: DataFrame) -> DataFrame:
    """(class_name, n, place): classes by falling count, ties by name; a row for each class."""
    rows = detections.groupBy("class_name").agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "class_name")))


def class_sets(labels: DataFrame, allowed: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """(image_id, classes, within, disjoint, found): an image's classes, whether they are all allowed, whether none is forbidden, and those that are."""
    rows = labels.groupBy("image_id").agg(F.sort_array(F.collect_set("class_name")).alias("c"))
    good, bad = (F.array(*[F.lit(x) for x in names]) for names in (allowed, forbidden))
    join = lambda a: F.array_join(a, ",")
    return rows.select("image_id", join("c").alias("classes"), (F.size(F.array_except("c", good)) == 0).alias("within"), (~F.arrays_overlap("c", bad)).alias("disjoint"), join(F.array_intersect("c", bad)).alias("found"))


def sites_of(images: DataFrame, sites: DataFrame) -> DataFrame:
    """images with their site: that of (image_id, site), else the stem of the file name."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return images.join(sites.select("image_id", "site"), "image_id", "left").withColumn("site", F.coalesce("site", stem))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of a sweep with the greatest f1, ties to the smaller one, and that f1."""
    return sweep.agg(F.min_by(F.struct("threshold", "f1"), F.struct((-F.coalesce("f1", F.lit(0.0))).alias("o"), "threshold")).alias("b")).select("b.threshold", "b.f1")
