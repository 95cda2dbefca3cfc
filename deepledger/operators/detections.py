"""Fusion, status, priority and read queries over detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deepledger.functions import constants as K
from deepledger.functions import geo, scores, text


def signals(rows: DataFrame) -> dict[str, Column]:
    """The six signals of fusion. Consistency is that of other frames if rows have it (consistency.with_consistency), else not available."""
    return {
        "detection": F.col("class_confidence"), "segmentation": scores.bell(F.col("mask_frac")), "natural": F.col("natural"),
        "shadow": F.col("shadow"), "physics": F.col("physics"), "consistency": _optional(rows, "consistency", "double"),
    }


def scored(detections: DataFrame) -> DataFrame:
    """detections with fusion, status, priority and tier. Null signals are left out of the fusion."""
    out = detections.withColumn("fusion", scores.fuse(signals(detections)))
    out = out.withColumns({"status": scores.status(F.col("fusion"), F.col("anomaly"), F.col("class_confidence")), "size_factor": scores.size_factor(F.col("w") / 4, F.col("h") / 4)})
    out = out.withColumn("priority", scores.priority(F.col("class_name"), F.col("fusion"), F.col("size_factor")))
    return out.withColumn("tier", scores.tier(F.col("priority")))


def hazard_ranking(detections: DataFrame) -> DataFrame:
    """Rank of each detection within its survey by priority, ties by id."""
    rank = F.row_number().over(Window.partitionBy("survey_id").orderBy(F.desc("priority"), "detection_id"))
    return scored(detections).select("survey_id", "detection_id", "class_name", "fusion", "status", "priority", "tier", rank.alias("hazard_rank"))


def fusion_breakdown(detections: DataFrame) -> DataFrame:
    return detections.select("detection_id", scores.fuse(signals(detections)).alias("fusion"), *[v.alias(f"part_{k}") for k, v in scores.fusion_parts(signals(detections)).items()])


def counts_by(detections: DataFrame) -> DataFrame:
    """Counts by class, status and tier in one pass over the detections."""
    sets = scored(detections).groupingSets([["class_name"], ["status"], ["tier"]], "class_name", "status", "tier")
    rows = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "class").when(F.col("g") == 5, "status").otherwise("tier")
    return rows.select(kind.alias("kind"), F.coalesce("class_name", "status", "tier").alias("value"), "n")


def class_shares(detections: DataFrame) -> DataFrame:
    """Counts by class with their share of the total and of the largest."""
    rows = detections.groupBy("class_name").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # a row for each class
    return rows.select("class_name", "n", F.round(F.col("n") / F.sum("n").over(every), 6).alias("of_total"), F.round(F.col("n") / F.max("n").over(every), 6).alias("of_largest"))


def survey_summary(detections: DataFrame) -> DataFrame:
    """Conditional counts for each survey."""
    return scored(detections).groupBy("survey_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status").isin("review", "human_review_required")).alias("in_review"),
        F.count_if(F.col("tier") == "high").alias("high"), F.count_if(F.col("tier") == "critical").alias("critical"), F.count_if(F.col("lat").isNotNull()).alias("located"), F.round(F.max("priority"), 1).alias("top_priority"),
    )


def explore(detections: DataFrame, status: str = "all", tier: str = "all", class_name: str = "all", search: str = "") -> DataFrame:
    """Detections of a status, tier and class whose id, class and file name hold a text, whatever its case; "all" filters nothing."""
    out = scored(detections)
    for column, wanted in (("status", status), ("tier", tier), ("class_name", class_name)):
        if wanted != "all":
            out = out.where(F.col(column) == wanted)
    return out.where(F.lower(F.concat_ws(" ", F.concat(F.lit("frame_"), F.col("image_id"), F.lit(".png")), "class_name", "detection_id")).contains(search.strip().lower()))


#: Columns of the detection report, in order.
REPORT = (
    "detection_id", "survey_id", "image", "class", "class_confidence", "status", "fusion_confidence", "box_x", "box_y", "box_w", "box_h", "mask_area_frac",
    "evidence_detection", "evidence_segmentation", "evidence_natural", "evidence_shadow", "evidence_physics", "evidence_consistency", "evidence_anomaly",
    "shadow_valid", "height_estimate_m", "geo_known", "lat", "lon", "uncertainty_m", "location_status", "position_source", "timestamp", "geo_bearing_deg",
    "geo_ground_range_m", "width_m", "length_m", "height_m", "priority_score", "priority_tier",
)


def _optional(rows: DataFrame, column: str, kind: str) -> Column:
    """A column of rows, null where rows have none of that name."""
    return F.col(column) if column in rows.columns else F.lit(None).cast(kind)


def timed(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """rows with captured_at of their frame, null where it is not known."""
    return rows.join(frames.select("image_id", "captured_at"), "image_id", "left")


def detection_report(detections: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """The rows of the flat report: the columns of REPORT for each detection, with its frame's time; null where nothing is known.

    Without frames, detections have that time already, as captured_at (`timed`).

    Columns that detections need not have: shadow_valid, height_estimate_m, location_status, nav_source, provenance_source,
    geo_bearing_deg, geo_ground_range_m, width_m, length_m, height_m, image_filename. A position set by hand comes from the user,
    others from the navigation's source if it has one, else from the provenance's.
    """
    rows = scored(detections if frames is None else timed(detections.drop("captured_at"), frames))
    get = lambda c, kind="double": _optional(rows, c, kind)
    where = text.location_status(get("location_status", "string"))
    source = F.when(where == "MANUAL", "user_supplied").otherwise(F.coalesce(F.nullif(get("nav_source", "string"), F.lit("")), get("provenance_source", "string")))
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    named = {
        "image": F.coalesce(get("image_filename", "string"), F.concat(F.lit("frame_"), F.col("image_id"), F.lit(".png"))), "class": F.col("class_name"), "fusion_confidence": F.col("fusion"),
        **{f"box_{c}": F.col(c) for c in "xywh"}, "mask_area_frac": F.col("mask_frac"), **{f"evidence_{k}": v for k, v in signals(rows).items()}, "evidence_anomaly": F.lit(None).cast("double"),
        "shadow_valid": get("shadow_valid", "boolean"), "geo_known": known, "location_status": where, "position_source": source,
        "timestamp": F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "priority_score": F.col("priority"), "priority_tier": F.col("tier"),
    }
    return rows.select(*[named.get(c, get(c)).alias(c) for c in REPORT])


def geojson_features(detections: DataFrame) -> DataFrame:
    """A GeoJSON feature for each detection; without a position its geometry is null and a note says so."""
    get = lambda c, kind="double": _optional(detections, c, kind)
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    point = F.when(known, F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    properties = F.struct(
        F.lit("detection").alias("kind"), F.col("detection_id"), get("image_filename", "string").alias("image"), F.col("class_name").alias("class"), get("status", "string").alias("status"),
        get("fusion").alias("fusion_confidence"), get("priority").alias("priority_score"), get("tier", "string").alias("priority_tier"), F.struct(*[get(c).alias(c) for c in ("width_m", "length_m", "height_m")]).alias("dimensions_m"),
        get("uncertainty_m").alias("uncertainty_m"), F.when(~known, F.coalesce(get("geo_note", "string"), F.lit("geolocation unavailable"))).alias("note"),
    )
    body = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), point.alias("geometry"))
    return detections.select("survey_id", "detection_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("feature"))


def ellipse_features(located: DataFrame) -> DataFrame:
    """A GeoJSON polygon around each detection of (survey_id, detection_id, lat, lon, semi_major_m, semi_minor_m, rotation_deg), none of them null."""
    sizes = ("semi_major_m", "semi_minor_m", "rotation_deg")
    rows = located.dropna(subset=["lat", "lon", *sizes])
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(geo.ring(F.col("lat"), F.col("lon"), *map(F.col, sizes))).alias("coordinates"))
    body = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("uncertainty_ellipse").alias("kind"), F.col("detection_id"), *sizes).alias("properties"), shape.alias("geometry"))
    return rows.select("survey_id", "detection_id", F.to_json(body).alias("feature"))


def track_features(fixes: DataFrame) -> DataFrame:
    """(survey_id, feature): a GeoJSON line over the fixes of (survey_id, fix_id, ts, lat, lon) by time, for each survey with two places or more. A survey's places meet in one row."""
    places = fixes.where("lat is not null and lon is not null").groupBy("survey_id").agg(F.sort_array(F.collect_list(F.struct("ts", "fix_id", "lon", "lat"))).alias("p")).where(F.size("p") >= 2)
    line = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda x: F.array(x["lon"], x["lat"])).alias("coordinates"))
    body = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("survey_track").alias("kind"), F.col("survey_id")).alias("properties"), line.alias("geometry"))
    return places.select("survey_id", F.to_json(body).alias("feature"))


def physics_records(detections: DataFrame) -> DataFrame:
    """(detection_id, metadata_sufficient, grazing_angle_deg, estimated_height_m, geometry_score, note) of rows with y, h, image_height, range_m, altitude_m, shadow_valid and height_estimate_m.

    Without a positive range there is no slant range, without one and a positive altitude below it no angle. A height is given only
    for a valid shadow with its own estimate and all metadata; the note says what is missing.
    """
    wide, high = F.coalesce(F.col("range_m") > 0, F.lit(False)), F.coalesce(F.col("altitude_m") > 0, F.lit(False))
    slant = F.when(wide & (F.col("image_height") > 0), geo.row_slant(F.col("y") + F.col("h") / 2, F.col("image_height"), F.col("range_m")))
    rows = detections.withColumns({"slant": slant, "valid": F.coalesce("shadow_valid", F.lit(False))}).withColumn("angle", scores.grazing_angle(F.col("altitude_m"), F.col("slant")))
    rows = rows.withColumn("enough", wide & high & F.col("slant").isNotNull() & F.col("valid") & F.col("height_estimate_m").isNotNull())
    shown = F.concat(F.lit("grazing "), F.bround("angle", 0).cast("long"), F.lit("°"))
    notes = F.array_compact(F.array(
        F.when(~wide, "sonar range missing"), F.when(~high, "sonar altitude missing"), F.when(F.col("slant").isNull() & wide, "row→slant-range conversion unavailable"),
        F.when(~F.col("valid"), "no valid acoustic shadow — height not estimable"),
        F.when(F.col("enough") & F.col("angle").isNotNull(), F.concat(shown, F.lit(f" within shadow window [{K.GRAZING_MIN:.0f}°, {K.GRAZING_MAX:.0f}°] — flat-seabed similar-triangles estimate")))
        .when(F.col("angle").isNotNull(), F.concat(shown, F.lit(" outside/edge of shadow window — treat height with caution"))),
    ))
    return rows.select(
        "detection_id", F.col("enough").alias("metadata_sufficient"), F.col("angle").alias("grazing_angle_deg"), F.when(F.col("enough"), F.round("height_estimate_m", 2)).alias("estimated_height_m"),
        scores.grazing_score(F.col("angle")).alias("geometry_score"), F.coalesce(F.nullif(F.array_join(notes, "; "), F.lit("")), F.lit("sonar geometry not assessable")).alias("note"),
    )


def survey_json(detections: DataFrame) -> DataFrame:
    """A JSON document for each survey with its detections by priority and a summary. One survey's rows meet in one group."""
    item = F.struct((-F.col("priority")).alias("order"), F.col("detection_id").alias("id"), F.col("class_name").alias("class"), "status", "priority")
    rows = scored(detections).groupBy("survey_id").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count("*").alias("n"), F.count_if(F.col("lat").isNotNull()).alias("located"))
    listed = F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["class"].alias("class"), x["status"].alias("status"), x["priority"].alias("priority")))
    return rows.select("survey_id", F.to_json(F.struct(listed.alias("detections"), F.struct("n", "located").alias("summary"))).alias("document"))


def upsert(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...]) -> DataFrame:
    """Rows of both by key, the new one's columns first; columns of `kept` fall back to the old value where the new one is null."""
    a, b = old.alias("a"), new.alias("b")
    is_new = F.col(f"b.{key}").isNotNull()
    pick = lambda c: F.coalesce(f"b.{c}", f"a.{c}") if c == key or c in kept else F.when(is_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*[pick(c).alias(c) for c in old.columns])


def replace_group(old: DataFrame, new: DataFrame, key: str, replaced: DataFrame) -> DataFrame:
    """All rows of the keys in `replaced` are those of new, also if that is none; other keys keep the old ones."""
    return old.join(replaced.select(key).distinct(), key, "left_anti").unionByName(new)
