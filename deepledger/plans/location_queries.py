"""Queries over positions, targets and consistency, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deepledger.functions import constants as K
from deepledger.functions import geo, scores
from deepledger.operators import consistency as C
from deepledger.operators import detections as D
from deepledger.operators import location as L
from deepledger.plans import oracles as S
from deepledger.sources import adapters as A


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.detections(spark, sf_dir).drop("survey_id", "frame_index").join(A.frames(spark, sf_dir), "image_id")


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.concat_ws("_", F.lit("tgt"), "survey_id", "class_name", F.floor(F.col("frame_index") / 4))
    return D.scored(A.detections(spark, sf_dir)).withColumn("target_id", target)


def geodesy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from the vessel to each detection, the way on over the sphere, ranges, and the grazing angle with its score."""
    r = _rows(spark, sf_dir).where("vessel_lat is not null")
    slant = geo.row_slant(F.col("y"), F.lit(A.IMAGE_HEIGHT), F.col("range_m"))
    on = geo.sphere_destination(F.col("vessel_lat"), F.col("vessel_lon"), F.col("heading_deg"), F.col("range_m"))
    angle = scores.grazing_angle(F.col("altitude_m"), slant)
    return r.select(
        "detection_id", F.round(geo.haversine(F.col("vessel_lat"), F.col("vessel_lon"), F.col("lat"), F.col("lon")), 2).alias("distance_m"), F.round(on["lat"], 7).alias("on_lat"), F.round(on["lon"], 7).alias("on_lon"),
        F.round(slant, 4).alias("slant_m"), F.round(geo.ground_range(slant, F.col("altitude_m")), 4).alias("ground_m"), geo.heading(F.col("heading_deg") - 400).alias("heading"), angle.alias("grazing_deg"), scores.grazing_score(angle).alias("geometry_score"),
    )


def geodesic_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = geo.geodesic(A.frames(spark, sf_dir), "end", F.col("vessel_lat"), F.col("vessel_lon"), F.col("heading_deg"), F.col("range_m") * 100)
    return f.select("image_id", F.round("end.lat", 7).alias("lat"), F.round("end.lon", 7).alias("lon"))


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of each detection from the across-track scale at its middle row; null without a range."""
    scale = scores.across_scale(F.col("y") + F.col("h") / 2, F.lit(A.IMAGE_HEIGHT), F.col("range_m"), F.col("altitude_m"))
    return _rows(spark, sf_dir).select("detection_id", F.when(F.col("range_m") > 0, F.round(F.col("w") * scale, 2)).alias("width_m"))


def locate_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.located(_rows(spark, sf_dir), A.IMAGE_HEIGHT)
    return r.select("detection_id", "location_status", F.round("slant_m", 3).alias("slant_m"), F.round("ground_m", 3).alias("ground_m"), F.round("bearing_deg", 3).alias("bearing_deg"), F.round("det_lat", 7).alias("lat"), F.round("det_lon", 7).alias("lon"))


def location_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.located(_rows(spark, sf_dir), A.IMAGE_HEIGHT).groupBy("location_status").agg(F.count("*").alias("n"))


def nav_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.checked(A.frames(spark, sf_dir)).select("image_id", F.array_join("nav_issues", "; ").alias("issues"), F.col("ok_lat").isNotNull().alias("has_fix"), F.col("ok_side").isNotNull().alias("has_side"))


def geolocation_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.diagnostics(A.frames(spark, sf_dir))


def uncertainty_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sigma ellipses of all located detections."""
    r = L.located(_rows(spark, sf_dir), A.IMAGE_HEIGHT).where("location_status = 'DERIVED'").withColumn("accuracy_m", F.col("uncertainty_m"))
    return L.uncertainty(r, "detection_id")


def ellipse_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring around each frame's fix: its corners 0, 9 and 18 and its number of points."""
    f = A.frames(spark, sf_dir).where("vessel_lat is not null")
    ring = geo.ring(F.col("vessel_lat"), F.col("vessel_lon"), F.col("range_m"), F.col("range_m") / 2, F.col("heading_deg"))
    f = f.select("image_id", ring.alias("ring"))
    return f.select("image_id", F.size("ring").alias("points"), *[F.round(F.col("ring")[i][j], 6).alias(f"{n}{i}") for i in (0, 9, 18) for j, n in ((0, "lon"), (1, "lat"))])


def target_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.target_states(_linked(spark, sf_dir))


def location_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.location_consistency(_linked(spark, sf_dir))


def fused_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fused_locations(_linked(spark, sf_dir))


def target_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's detections with their place in its history and whether they represent it."""
    linked = _linked(spark, sf_dir)
    from pyspark.sql import Window

    order = Window.partitionBy("target_id").orderBy("frame_index", "image_id", "detection_id")
    best = L.target_states(linked).select("target_id", "representative")
    rows = linked.withColumn("step", F.row_number().over(order)).join(best, "target_id")
    return rows.select("target_id", "detection_id", "step", "fusion", (F.col("detection_id") == F.col("representative")).alias("is_representative"))


def map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located targets of one class whose id holds a text."""
    states = L.target_states(_linked(spark, sf_dir))
    return states.where("lat is not null").where(F.lower("target_id").contains("_tire_")).select("target_id", "n", "location_from")


def consistency_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each detection from other frames: places near its own, and boxes where a place is not known."""
    return C.corroboration(A.detections(spark, sf_dir), A.frame_sizes(spark, sf_dir))


def box_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlap_pairs(A.detections(spark, sf_dir), A.frame_sizes(spark, sf_dir))


def spatial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = L.bounds(A.frames(spark, sf_dir), A.detections(spark, sf_dir))
    return b.select("survey_id", "points", *[F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


def association_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.snapshot_candidates(A.detections(spark, sf_dir)).select("detection_id", "candidate_id", "score", "candidate_rank", "verdict")


QUERIES = {
    f.__name__: f
    for f in (
        geodesy, geodesic_direct, dimensions, locate_detections, location_status_counts, nav_inputs, geolocation_diagnostics, uncertainty_ellipse, ellipse_polygon, target_states, location_consistency,
        fused_locations, target_history, map_filter, consistency_views, box_overlap_pairs, spatial_summary, association_snapshot,
    )
}

_ROWS = A.DETECTIONS + ", placed as (select d.* exclude (survey_id, frame_index), f.* exclude (image_id) from detections d join frames f using (image_id))"
_LINKED = S.SCORED + ", linked as (select *, concat_ws('_', 'tgt', survey_id, class_name, frame_index // 4) as target_id from scored)"
_H = A.IMAGE_HEIGHT - 1
_SLANT = f"(range_m * greatest(0.0::double, least(1.0::double, (y + h / 2) / {_H})))"


def _ground(slant: str) -> str:
    return f"(case when altitude_m <= 0 then {slant} else sqrt(greatest(0.0::double, {slant} * {slant} - altitude_m * altitude_m)) end)"


_ON = "(radians(heading_deg))"
_CHECKED = """, checked as (select *, vessel_lat is not null and vessel_lon is not null as fix, case when side in ('port', 'starboard') then side end as ok_side, case when altitude_m > 0 then altitude_m end as ok_altitude from placed)"""
_SIN = "sin(radians(vessel_lat)) * cos(range_m / 6371008.8::double) + cos(radians(vessel_lat)) * sin(range_m / 6371008.8::double) * cos(radians(heading_deg))"
_LOCATED = (
    _ROWS
    + _CHECKED
    + f""", raw as (select *, {_SLANT} as slant_m, case when abs(roll_deg) > 0.01 then greatest(0.1::double, ok_altitude * cos(radians(roll_deg))) else ok_altitude end as effective_m,
        coalesce(case when abs(pitch_deg) > 0.01 then ok_altitude * tan(radians(pitch_deg)) end, 0) as along_m from checked), """
    + S.geodesic("raw", "sensor", "vessel_lat", "vessel_lon", S.pmod360("heading_deg + 180"), "coalesce(layback_m, 0)")
    + f""", ready_ as (select *, coalesce(vessel_lat is not null and ok_side is not null and slant_m > 0 and slant_m > effective_m, false) as ready from sensor),
    abeam_ as (select *, case when ready then (case when effective_m <= 0 then slant_m else sqrt(greatest(0.0::double, slant_m * slant_m - effective_m * effective_m)) end) end as ground_m,
        case when ready then {S.pmod360("heading_deg + case when ok_side = 'starboard' then 90 else -90 end")} end as bearing_deg from ready_), """
    + S.geodesic("abeam_", "abeam", "sensor_lat", "sensor_lon", "bearing_deg", "ground_m")
    + ", "
    + S.geodesic("abeam", "spot", "abeam_lat", "abeam_lon", f"case when along_m > 0 then heading_deg else {S.pmod360('heading_deg + 180')} end", "case when ready then case when abs(along_m) > 0.01 then abs(along_m) else 0 end end")
    + """, located as (select *, case when ready then 'DERIVED' when fix then 'VESSEL_ONLY' else 'UNAVAILABLE' end as location_status from spot)"""
)
_UNC = "coalesce(case when uncertainty_m > 0 then uncertainty_m end, 10)"

ORACLES = {
    "geodesy": f"""with {_ROWS}, s as (select *, range_m * greatest(0.0::double, least(1.0::double, y / {_H})) as slant from placed where vessel_lat is not null),
        g as (select *, case when altitude_m > 0 and slant >= altitude_m then round(degrees(asin(altitude_m / slant)), 1) end as grazing_deg, {_SIN} as sn from s)
        select detection_id, round({S.haversine('vessel_lat', 'vessel_lon', 'lat', 'lon')}, 2) as distance_m, round(degrees(asin(sn)), 7) as on_lat,
            round(vessel_lon + degrees(atan2(sin(radians(heading_deg)) * sin(range_m / 6371008.8::double) * cos(radians(vessel_lat)), cos(range_m / 6371008.8::double) - sin(radians(vessel_lat)) * sn)), 7) as on_lon,
            round(slant, 4) as slant_m, round({_ground('slant')}, 4) as ground_m, {S.pmod360('heading_deg - 400')} as heading, grazing_deg,
            round(case when grazing_deg < 8 then greatest(0.0::double, 1 - (8 - grazing_deg) / 4) when grazing_deg > 65 then greatest(0.0::double, 1 - (grazing_deg - 65) / 32.5::double) when grazing_deg is not null then 1 end, 3) as geometry_score from g""",
    "geodesic_direct": f"with {A.FRAMES}, {S.geodesic('frames', 'g', 'vessel_lat', 'vessel_lon', 'heading_deg', 'range_m * 100')} select image_id, round(g_lat, 7) as lat, round(g_lon, 7) as lon from g",
    "dimensions": f"""with {_ROWS}, s as (select *, {_SLANT} as s0, range_m * greatest(0.0::double, least(1.0::double, (y + h / 2 + 1) / {_H})) as s1 from placed)
        select detection_id, case when range_m > 0 then round(w * greatest(1e-6::double, {_ground('s1')} - {_ground('s0')}), 2) end as width_m from s""",
    "locate_detections": f"with {_LOCATED} select detection_id, location_status, round(slant_m, 3) as slant_m, round(ground_m, 3) as ground_m, round(bearing_deg, 3) as bearing_deg, case when ready then round(spot_lat, 7) end as lat, case when ready then round(spot_lon, 7) end as lon from located",
    "location_status_counts": f"with {_LOCATED} select location_status, count(*) as n from located group by 1",
    "nav_inputs": f"""with {A.FRAMES} select image_id, array_to_string(list_filter([case when vessel_lat is null then 'GPS unavailable in metadata' end, case when altitude_m <= 0 then 'altitude invalid (must be finite > 0)' end,
        case when side = 'unknown' then 'sonar side not port/starboard' end], lambda x: x is not null), '; ') as issues, vessel_lat is not null as has_fix, side <> 'unknown' as has_side from frames""",
    "geolocation_diagnostics": f"""with {A.FRAMES} select survey_id, count(*) as frames, count(vessel_lat) as with_fix, case when bool_or(heading_deg is not null) then 'ok' else 'missing' end as heading, case when bool_or(altitude_m > 0) then 'ok' else 'missing' end as altitude,
        case when bool_or(side <> 'unknown') then 'ok' else 'missing' end as side, case when bool_or(layback_m is not null) then 'ok' else 'missing' end as layback,
        sum((vessel_lat is null)::bigint + (altitude_m <= 0)::bigint + (side = 'unknown')::bigint)::bigint as issues from frames group by 1""",
    "uncertainty_ellipse": f"""with {_LOCATED}, draws(zh, ze, zn, zr, za) as (values {", ".join(str(tuple(f"{float(v)!r}::double" for v in row)).replace("'", "") for row in zip(*L.draws()))}),
        drawn as (select detection_id, sqrt(greatest(0.0::double, pow(slant_m * (1 + zr * {K.RANGE_SIGMA}::double), 2) - pow(effective_m * (1 + za * {K.ALTITUDE_SIGMA}::double), 2))) as ground,
            radians(heading_deg + case when ok_side = 'starboard' then 90 else -90 end + zh * {K.HEADING_SIGMA}::double) as bearing, greatest({K.GPS_SIGMA_MIN}::double, case when uncertainty_m > 0 then uncertainty_m else {K.GPS_SIGMA}::double end) as gps, ze, zn
            from located, draws where location_status = 'DERIVED'),
        c as (select detection_id, var_samp(e) as ee, var_samp(n) as nn, covar_samp(e, n) as en from (select detection_id, ground * sin(bearing) + gps * ze as e, ground * cos(bearing) + gps * zn as n from drawn) group by 1),
        axes as (select *, (ee + nn) / 2 as mid, sqrt(pow((ee - nn) / 2, 2) + en * en) as spread from c), x as (select *, 2 * sqrt(mid + spread) as major, 2 * sqrt(greatest(0.0::double, mid - spread)) as minor from axes)
        select detection_id, round(sqrt(major * minor), 1) as radius_m, round(major, 1) as semi_major_m, round(minor, 1) as semi_minor_m, round(degrees(atan2(2 * en, ee - nn) / 2), 1) as rotation_deg from x""",
    "ellipse_polygon": "with " + A.FRAMES + " select image_id, 37 as points, " + ", ".join(
        f"round(round({'vessel_lon' if n == 'lon' else 'vessel_lat'} + ({e}) / ({'111320.0::double * cos(radians(vessel_lat))' if n == 'lon' else '111320.0::double'}), 7), 6) as {n}{i}"
        for i in (0, 9, 18) for n, e in (("lon", f"range_m * cos(radians({i * 10})) * cos(radians(heading_deg)) - range_m / 2 * sin(radians({i * 10})) * sin(radians(heading_deg))"), ("lat", f"range_m * cos(radians({i * 10})) * sin(radians(heading_deg)) + range_m / 2 * sin(radians({i * 10})) * cos(radians(heading_deg))"))
    ) + " from frames where vessel_lat is not null",
    "target_states": f"""with {_LINKED}, r as (select *, row_number() over (partition by target_id order by fusion desc, frame_index, image_id, detection_id) as b, row_number() over (partition by target_id order by frame_index, image_id, detection_id) as f,
            row_number() over (partition by target_id order by frame_index desc, image_id desc, detection_id desc) as l, row_number() over (partition by target_id order by lat is null, case when uncertainty_m > 0 then uncertainty_m else 1e9::double end, detection_id) as u from linked),
        t as (select target_id, count(*) as n, max(case when f = 1 then image_id end) as first_image, max(case when l = 1 then image_id end) as last_image, max(case when b = 1 then detection_id end) as representative, max(fusion) as confidence,
            max(case when b = 1 then lat end) as lat1, max(case when b = 1 then lon end) as lon1, max(case when u = 1 then lat end) as lat2, max(case when u = 1 then lon end) as lon2 from r group by 1)
        select target_id, n, first_image, last_image, representative, confidence, coalesce(lat1, lat2) as lat, coalesce(lon1, lon2) as lon, case when lat1 is not null then 'representative' when lat2 is not null then 'lowest_uncertainty' else 'unknown' end as location_from from t""",
    "location_consistency": f"""with {_LINKED}, s as (select * from linked where lat is not null), n as (select target_id, count(*) as n, avg(uncertainty_m) as u from s group by 1 having count(*) > 1),
        d as (select a.target_id, max({S.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}) as d from s a join s b on a.target_id = b.target_id and a.detection_id < b.detection_id group by 1), t as (select *, greatest(2 * u, 20) as lim from n join d using (target_id))
        select target_id, n, round(d, 1) as dispersion_m, round(lim, 1) as threshold_m, round(greatest(0.0::double, 1 - d / lim), 3) as score, case when d <= lim then 'consistent' else 'inconsistent' end as status from t""",
    "fused_locations": f"""with {_LINKED}, t as (select target_id, count(*) as n, sum(1 / pow(greatest(0.5::double, {_UNC}), 2)) as t, sum(lat / pow(greatest(0.5::double, {_UNC}), 2)) as a, sum(lon / pow(greatest(0.5::double, {_UNC}), 2)) as o, max(lat) as la, max(lon) as lo, max(uncertainty_m) as u from linked where lat is not null group by 1)
        select target_id, n, case when n = 1 then la else round(a / t, 7) end as lat, case when n = 1 then lo else round(o / t, 7) end as lon, case when n = 1 then u else round(1 / sqrt(t), 2) end as uncertainty_m,
            case when n > 1 then round(greatest(round(1 / sqrt(t), 2) * 1.2::double, 0.5::double), 1) end as semi_major_m, case when n > 1 then round(greatest(round(1 / sqrt(t), 2) * 0.8::double, 0.3::double), 1) end as semi_minor_m from t""",
    "target_history": f"with {_LINKED} select target_id, detection_id, row_number() over (partition by target_id order by frame_index, image_id, detection_id) as step, fusion, row_number() over (partition by target_id order by fusion desc, frame_index, image_id, detection_id) = 1 as is_representative from linked",
    "map_filter": f"""with {_LINKED}, r as (select *, row_number() over (partition by target_id order by fusion desc, frame_index, image_id, detection_id) as b from linked)
        select target_id, count(*) as n, case when max(case when b = 1 then lat end) is not null then 'representative' else 'lowest_uncertainty' end as location_from from r where class_name = 'tire' group by 1 having max(lat) is not null""",
    "consistency_views": f"with {S.CONSISTENT} select survey_id, detection_id, views, available, consistency as evidence from consistent",
    "box_overlap_pairs": f"with {S.OVERLAPS} select survey_id, first_id, second_id, overlap from overlapping",
    "spatial_summary": f"""with {A.DETECTIONS}, p as (select survey_id, vessel_lat as lat, vessel_lon as lon from frames union all select survey_id, lat, lon from detections)
        select survey_id, count(*) as points, round(min(lat), 6) as min_lat, round(max(lat), 6) as max_lat, round(min(lon), 6) as min_lon, round(max(lon), 6) as max_lon from p where lat is not null group by 1""",
    "association_snapshot": f"""with {A.DETECTIONS}, c as (select a.survey_id, a.detection_id, b.detection_id as candidate_id, a.class_name = b.class_name as same, case when a.lat is not null and b.lat is not null then {S.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} end as dist, {S.iou('a', 'b')} as ov
            from detections a join detections b on a.survey_id = b.survey_id and a.frame_index = b.frame_index + 1),
        m as (select *, (0.35::double * same::int + 0.30::double * coalesce({S.ramp('dist', 8, 40)}, 0) + 0.15::double * 1 + 0.20::double * {S.ramp('1 - ov', 0.45, 0.95)}) / (0.35::double + case when dist is null then 0 else 0.30::double end + 0.15::double + 0.20::double) as mean from c),
        s as (select *, round(mean * case when same then 1 else 0.35::double end * case when round(dist, 1) > 40 then 0.35::double else 1 end * case when round(ov, 3) <= 0 then 0.5::double else 1 end, 4) as score from m),
        r as (select *, row_number() over w as candidate_rank, round(score - lead(score) over w, 4) as margin from s window w as (partition by survey_id, detection_id order by score desc, candidate_id))
        select detection_id, candidate_id, score, candidate_rank, case when candidate_rank = 1 then case when score < 0.62 then 'below_threshold' when margin < 0.06 then 'ambiguous' else 'accepted' end end as verdict from r where candidate_rank <= 5""",
}
