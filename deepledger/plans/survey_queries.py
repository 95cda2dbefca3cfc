"""Queries over detections and navigation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deepledger.functions import constants as K
from deepledger.operators import consistency as C
from deepledger.operators import detections as D
from deepledger.operators import navigation as N
from deepledger.plans import oracles as S
from deepledger.sources import adapters as A


def hazard_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hazard_ranking(A.detections(spark, sf_dir))


def fusion_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion and what each signal adds to it, evidence from other frames included."""
    return D.fusion_breakdown(C.with_consistency(A.detections(spark, sf_dir), A.frame_sizes(spark, sf_dir)))


def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.counts_by(A.detections(spark, sf_dir))


def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.class_shares(A.detections(spark, sf_dir))


def survey_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.survey_summary(A.detections(spark, sf_dir))


def explorer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.explore(A.detections(spark, sf_dir), status="review", class_name="wreck", search=" FRAME_1 ").select("survey_id", "detection_id", "status", "tier", "priority")


def class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.detections(spark, sf_dir).select("class_name").distinct()


def _reported(detections: DataFrame) -> DataFrame:
    """Detections with the state and source of their location, some under older names, and sizes."""
    state = F.when(F.col("lat").isNull(), "unknown").when(F.col("h") == 14, "Manual").when(F.col("h") == 20, "known").when(F.col("h") == 26, "elsewhere").otherwise("approximate")
    return detections.withColumns({
        "location_status": state, "nav_source": F.when(F.col("h") == 32, "csv").when(F.col("h") == 20, ""), "provenance_source": F.when(F.col("lat").isNotNull(), "sonar_geometry"),
        "width_m": F.col("w") / 4, "length_m": F.col("h") / 4, "shadow_valid": F.col("shadow") > 0.6, "height_estimate_m": F.when(F.col("shadow") > 0.7, F.col("shadow") * 3), "image_height": F.lit(A.IMAGE_HEIGHT),
    })


def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat report after the survey's pass over all frames. Line items go to their survey, with their frame's time, and are made detections there."""
    rows = D.timed(A.detection_rows(spark, sf_dir).drop("frame_index"), A.frames(spark, sf_dir))
    columns = {c: v for c, v in A.detection_columns().items() if c != "frame_index"} | {"captured_at": F.col("captured_at")}
    return D.detection_report(_reported(C.with_consistency(rows, A.frame_sizes(spark, sf_dir), columns)))


def physics_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = A.frames(spark, sf_dir).select("image_id", F.when(F.col("range_m") != 40, F.col("range_m")).alias("range_m"), F.when(F.col("altitude_m") != 3, F.col("altitude_m")).alias("altitude_m"))
    return D.physics_records(_reported(A.detections(spark, sf_dir)).join(frames, "image_id"))


#: What the query reads back from a feature.
_FEATURE = "geometry struct<type: string, coordinates: array<double>>, properties struct<class: string, note: string, priority_score: double, dimensions_m: struct<width_m: double>>"


def geojson_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all detections, each parsed once."""
    rows = D.geojson_features(D.scored(_reported(A.detections(spark, sf_dir)))).withColumn("read", F.from_json("feature", _FEATURE))
    place = lambda i: F.round(F.get("read.geometry.coordinates", F.lit(i)), 5)
    return rows.select(
        "survey_id", "detection_id", F.col("read.geometry.type").alias("kind"), place(0).alias("lon"), place(1).alias("lat"),
        F.col("read.properties.class").alias("class_name"), F.col("read.properties.note").alias("note"), F.col("read.properties.priority_score").alias("priority"), F.col("read.properties.dimensions_m.width_m").alias("width_m"),
    )


def track_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.track_features(A.navigation(spark, sf_dir))
    line = F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<double>>")
    return rows.select("survey_id", F.get_json_object("feature", "$.geometry.type").alias("kind"), F.size(line).cast("long").alias("places"), F.round(F.element_at(line, 1)[0], 6).alias("first_lon"), F.round(F.element_at(line, -1)[1], 6).alias("last_lat"))


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.survey_json(A.detections(spark, sf_dir))
    read = lambda path: F.get_json_object("document", path)
    return rows.select("survey_id", read("$.summary.n").cast("long").alias("n"), read("$.summary.located").cast("long").alias("located"), read("$.detections[0].id").alias("first_id"), read("$.detections[0].priority").cast("double").alias("first_priority"))


def dashboard_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six surveys of the latest frame, with frame counts and their latest job's status."""
    o = A.read(spark, sf_dir, "orders")
    rows = o.groupBy(F.col("o_custkey").alias("survey_id")).agg(F.count("*").alias("frames"), F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("job"))
    return rows.orderBy(F.desc("job.o_orderdate"), F.desc("job.o_orderkey")).limit(6).select("survey_id", "frames", F.col("job.o_orderkey").alias("job_id"), F.col("job.o_orderstatus").alias("job_status"))


def survey_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every survey, those without a frame too, with its latest job."""
    c = A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("survey_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"))
    nation = A.read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("area"))
    jobs = A.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("survey_id")).agg(F.count("*").alias("frames"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("job_status"))
    return c.join(nation, "n_nationkey").join(jobs, "survey_id", "left").select("survey_id", "name", "area", F.coalesce("frames", F.lit(0)).alias("frames"), "job_status")


def upsert_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of lineitem rows, updated by a later batch whose null links do not clear older ones."""
    d = A.detections(spark, sf_dir)
    old = d.where("uncertainty_m is null or uncertainty_m < 6").select("detection_id", F.col("frame_index").alias("target_id"), F.col("class_confidence").alias("confidence"))
    new = d.where("uncertainty_m is null or uncertainty_m >= 3").select("detection_id", F.when(F.col("x") > 200, F.col("frame_index") + 1).alias("target_id"), (F.col("class_confidence") + 1).alias("confidence"))
    return D.upsert(old, new, "detection_id", ("target_id",))


def replace_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fix counts after the odd surveys' fixes are replaced by their valid ones above zero altitude 20."""
    nav = A.navigation(spark, sf_dir).select("survey_id", "fix_id", "altitude_m")
    odd = nav.where("survey_id % 2 = 1")
    return D.replace_group(nav, odd.where("altitude_m > 20"), "survey_id", odd).groupBy("survey_id").agg(F.count("*").alias("fixes"))


def nav_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.validated(A.navigation(spark, sf_dir))
    return rows.select("survey_id", "fix_id", "reject_reason", F.array_join("issues", "; ").alias("issues"))


def nav_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.validated(A.navigation(spark, sf_dir)).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def track_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.diagnosed(A.navigation(spark, sf_dir)).select("survey_id", "fix_id", F.round("dt_s", 3).alias("dt_s"), F.round("step_m", 2).alias("step_m"), "invalid")


def track_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.track_stats(A.navigation(spark, sf_dir))


def frame_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.synchronised(A.frame_clock(spark, sf_dir), A.navigation(spark, sf_dir))


def nav_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.sessions(A.navigation(spark, sf_dir))


def track_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each survey's valid coordinates in time order as text, in millionths of a degree; null with fewer than two."""
    rows = N.diagnosed(A.navigation(spark, sf_dir)).groupBy("survey_id").agg(F.sort_array(F.collect_list(F.struct("ts", "fix_id", "lon", "lat"))).alias("p"))
    line = F.array_join(F.transform("p", lambda p: F.concat_ws(" ", *[F.round(p[c] * 1e6).cast("long").cast("string") for c in ("lon", "lat")])), ",")
    return rows.select("survey_id", F.size("p").alias("points"), F.when(F.size("p") >= 2, line).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        hazard_ranking, fusion_breakdown, detection_counts, class_shares, survey_summary, explorer_filter, class_list, csv_report, physics_records, geojson_report, track_lines, json_report, dashboard_recent, survey_cards,
        upsert_detections, replace_navigation, nav_validation, nav_reject_reasons, track_diagnostics, track_stats, frame_sync, nav_sessions, track_coordinates,
    )
}

_VALID = A.NAVIGATION + """, checked as (
    select *, case when lat is null or lon is null then 'missing coordinates' when abs(lat) > 90 then 'latitude outside valid range [-90, 90]' when abs(lon) > 180 then 'longitude outside valid range [-180, 180]' end as reject_reason from navigation)"""
_STEPS = _VALID + f""", steps as (
    select *, (epoch_us(ts) - epoch_us(lag(ts) over o)) / 1e6::double as dt_s, {S.haversine('lag(lat) over o', 'lag(lon) over o', 'lat', 'lon')} as step_m, lag(lat) over o = lat and lag(lon) over o = lon as same
    from checked where reject_reason is null and ts is not null window o as (partition by survey_id order by ts, fix_id)),
  flags as (select *, coalesce(dt_s <= 0 and same, false) as duplicate, coalesce(dt_s > 0 and step_m / nullif(dt_s, 0) > 15 and step_m > 50, false) as jump from steps),
  diagnosed as (select *, case when duplicate then 'duplicate timestamp' when jump or coalesce(lead(jump) over (partition by survey_id order by ts, fix_id), false) then 'impossible jump' end as invalid from flags)"""

_ALL = S.SIGNALS | {"consistency": "consistency"}
_REPORTS = ", reported as (select *, shadow > 0.6::double as shadow_valid, case when shadow > 0.7::double then shadow * 3 end as height_estimate_m from scored)"
_REPORTED = S.SCORED + _REPORTS

ORACLES = {
    "hazard_ranking": f"with {S.SCORED} select survey_id, detection_id, class_name, fusion, status, priority, tier, row_number() over (partition by survey_id order by priority desc, detection_id) as hazard_rank from scored",
    "fusion_breakdown": f"with {S.CONSISTENT} select detection_id, {S.fusion_of(_ALL)} as fusion, " + ", ".join(f"round({v} * {K.FUSION_WEIGHTS[k]}::double / {S.used_of(_ALL)}, 4) as part_{k}" for k, v in _ALL.items()) + " from consistent",
    "detection_counts": f"with {S.SCORED} select case when grouping(class_name) = 0 then 'class' when grouping(status) = 0 then 'status' else 'tier' end as kind, coalesce(class_name, status, tier) as \"value\", count(*) as n from scored group by grouping sets ((class_name), (status), (tier))",
    "class_shares": f"with {A.DETECTIONS}, n as (select class_name, count(*) as n from detections group by 1) select class_name, n, round(n / sum(n) over (), 6) as of_total, round(n / max(n) over (), 6) as of_largest from n",
    "survey_summary": f"""with {S.SCORED} select survey_id, count(*) as n, count(*) filter (status = 'confirmed') as confirmed, count(*) filter (status in ('review', 'human_review_required')) as in_review,
        count(*) filter (tier = 'high') as high, count(*) filter (tier = 'critical') as critical, count(lat) as located, round(max(priority), 1) as top_priority from scored group by 1""",
    "explorer_filter": f"with {S.SCORED} select survey_id, detection_id, status, tier, priority from scored where status = 'review' and class_name = 'wreck' and contains(lower('frame_' || image_id || '.png ' || class_name || ' ' || detection_id), 'frame_1')",
    "class_list": f"with {A.DETECTIONS} select distinct class_name from detections",
    "csv_report": f"""with {S.SCORED_CONSISTENT + _REPORTS} select detection_id, r.survey_id, 'frame_' || image_id || '.png' as image, class_name as class, class_confidence, status, fusion as fusion_confidence, x as box_x, y as box_y, w as box_w, h as box_h, mask_frac as mask_area_frac,
        class_confidence as evidence_detection, {S.BELL} as evidence_segmentation, natural_ as evidence_natural, shadow as evidence_shadow, physics as evidence_physics, consistency as evidence_consistency, null::double as evidence_anomaly, shadow_valid,
        height_estimate_m, lat is not null as geo_known, lat, lon, uncertainty_m, case when lat is null or h = 26 then 'UNAVAILABLE' when h = 14 then 'MANUAL' when h = 20 then 'VERIFIED' else 'DERIVED' end as location_status,
        case when lat is not null and h = 14 then 'user_supplied' when h = 32 then 'csv' when lat is not null then 'sonar_geometry' end as position_source, strftime(f.captured_at, '%Y-%m-%dT%H:%M:%SZ') as "timestamp", null::double as geo_bearing_deg,
        null::double as geo_ground_range_m, w / 4 as width_m, h / 4 as length_m, null::double as height_m, priority as priority_score, tier as priority_tier from reported r left join frames f using (image_id)""",
    "physics_records": f"""with {_REPORTED}, g as (select r.*, nullif(f.range_m, 40) as range_m, nullif(f.altitude_m, 3) as altitude_m from reported r join frames f using (image_id)),
        a as (select *, range_m * greatest(0, least(1, (y + h / 2) / 511)) as slant from g), b as (select *, case when altitude_m > 0 and slant >= altitude_m then round(degrees(asin(altitude_m / slant)), 1) end as angle from a),
        c as (select *, coalesce(range_m > 0 and altitude_m > 0 and shadow_valid and height_estimate_m is not null, false) as enough from b)
        select detection_id, enough as metadata_sufficient, angle as grazing_angle_deg, case when enough then round(height_estimate_m, 2) end as estimated_height_m,
            round(case when angle < 8 then greatest(0.0::double, 1 - (8 - angle) / 4) when angle > 65 then greatest(0.0::double, 1 - (angle - 65) / 32.5::double) when angle is not null then 1 end, 3) as geometry_score,
            coalesce(nullif(concat_ws('; ', case when range_m is null then 'sonar range missing' end, case when altitude_m is null or altitude_m <= 0 then 'sonar altitude missing' end, case when not coalesce(shadow_valid, false) then 'no valid acoustic shadow — height not estimable' end,
                case when angle is not null then 'grazing ' || round_even(angle, 0)::bigint || '°' || case when enough then ' within shadow window [8°, 65°] — flat-seabed similar-triangles estimate' else ' outside/edge of shadow window — treat height with caution' end end), ''), 'sonar geometry not assessable') as note from c""",
    "geojson_report": f"with {_REPORTED} select survey_id, detection_id, case when lat is not null then 'Point' end as kind, round(lon, 5) as lon, round(lat, 5) as lat, class_name, case when lat is null then 'geolocation unavailable' end as note, priority, w / 4 as width_m from reported",
    "track_lines": f"with {A.NAVIGATION} select survey_id, 'LineString' as kind, count(*) as places, round(arg_min(lon, (ts, fix_id)), 6) as first_lon, round(arg_max(lat, (ts, fix_id)), 6) as last_lat from navigation where lat is not null and lon is not null group by 1 having count(*) >= 2",
    "json_report": f"with {S.SCORED}, r as (select *, row_number() over (partition by survey_id order by priority desc, detection_id) as k from scored) select survey_id, count(*) as n, count(lat) as located, max(case when k = 1 then detection_id end) as first_id, max(case when k = 1 then priority end) as first_priority from r group by 1",
    "dashboard_recent": "select o_custkey as survey_id, count(*) as frames, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as job_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as job_status from orders group by 1 order by max((o_orderdate, o_orderkey)) desc limit 6",
    "survey_cards": "select c_custkey as survey_id, c_name as name, n_name as area, count(o_orderkey) as frames, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as job_status from customer join nation on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1, 2, 3",
    "upsert_detections": f"""with {A.DETECTIONS}, old as (select detection_id, frame_index as target_id, class_confidence as confidence from detections where uncertainty_m is null or uncertainty_m < 6),
        new as (select detection_id, case when x > 200 then frame_index + 1 end as target_id, class_confidence + 1 as confidence from detections where uncertainty_m is null or uncertainty_m >= 3)
        select coalesce(new.detection_id, old.detection_id) as detection_id, coalesce(new.target_id, old.target_id) as target_id, case when new.detection_id is not null then new.confidence else old.confidence end as confidence from old full join new on old.detection_id = new.detection_id""",
    "replace_navigation": f"with {A.NAVIGATION} select survey_id, count(*) as fixes from navigation where survey_id % 2 = 0 or altitude_m > 20 group by 1",
    "nav_validation": f"""with {_VALID} select survey_id, fix_id, reject_reason, array_to_string(list_filter([case when ts is null then 'timestamp missing' end, case when heading_deg < 0 or heading_deg > 360 then 'heading outside valid range [0, 360]' end,
        case when altitude_m < 0 then 'altitude negative' end, case when accuracy_m < 0 then 'accuracy negative' end], lambda x: x is not null), '; ') as issues from checked""",
    "nav_reject_reasons": f"with {_VALID} select coalesce(reject_reason, 'valid') as reason, count(*) as n from checked group by 1",
    "track_diagnostics": f"with {_STEPS} select survey_id, fix_id, round(dt_s, 3) as dt_s, round(step_m, 2) as step_m, invalid from diagnosed",
    "track_stats": f"""with {_STEPS}, t as (select survey_id, count(*) as total, count(reject_reason) as rejected from checked group by 1),
        s as (select survey_id, count(*) filter (invalid is null) as valid, count(*) filter (duplicate) as duplicates, count(*) filter (invalid = 'impossible jump') as jump_ends, count(*) filter (dt_s > 60) as gaps, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::double, 3) as span_s from diagnosed group by 1)
        select * from t left join s using (survey_id)""",
    "frame_sync": f"""with {_STEPS}, {A.FRAME_CLOCK}, fix as (select *, {S.pmod360('heading_deg')} as hd from diagnosed where invalid is null),
        pairs as (select c.survey_id, c.frame_id, c.ts, f.ts as fts, f.fix_id, f.lat, f.lon, f.hd, f.altitude_m, f.accuracy_m from clock c left join fix f on f.survey_id = c.survey_id),
        s as (select survey_id, frame_id, ts, min((fts, fix_id, lat, lon, hd, altitude_m, accuracy_m)) filter (abs(epoch_us(fts) - epoch_us(ts)) <= 1000000) as e,
            max((fts, fix_id, lat, lon, hd, altitude_m, accuracy_m)) filter (fts <= ts) as a, min((fts, fix_id, lat, lon, hd, altitude_m, accuracy_m)) filter (fts > ts) as b from pairs group by all),
        m as (select *, case when e is not null then 'exact_timestamp' when a is not null and b is not null then 'interpolated' when coalesce(a, b) is not null then 'nearest' else 'none' end as method,
            (epoch_us(ts) - epoch_us(a[1])) / (epoch_us(b[1]) - epoch_us(a[1])) as k, coalesce(e, a, b) as o from s)
        select survey_id, frame_id, method, round(case when method = 'interpolated' then a[3] + (b[3] - a[3]) * k else o[3] end, 7) as lat, round(case when method = 'interpolated' then a[4] + (b[4] - a[4]) * k else o[4] end, 7) as lon,
            round(case when method = 'interpolated' then {S.pmod360(f"a[5] + ({S.pmod360('b[5] - a[5] + 540')} - 180) * k")} else o[5] end, 4) as heading_deg,
            round(case when method = 'interpolated' then a[6] + (b[6] - a[6]) * k else o[6] end, 4) as altitude_m, case when method = 'interpolated' then greatest(a[7], b[7]) else o[7] end as accuracy_m from m""",
    "nav_sessions": f"""with {A.NAVIGATION}, g as (select *, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by survey_id order by ts)) >= 21600000000, true)::int as fresh from navigation),
        s as (select *, sum(fresh) over (partition by survey_id order by ts rows unbounded preceding) as k from g) select survey_id, count(*) as fixes, min(ts) as started, max(ts) as ended from s group by survey_id, k""",
    "track_coordinates": f"with {_STEPS} select survey_id, count(*) as points, case when count(*) >= 2 then string_agg(round(lon * 1e6)::bigint || ' ' || round(lat * 1e6)::bigint, ',' order by ts, fix_id) end as line from diagnosed group by 1",
}
