"""Queries over reports, checks of inputs and orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deepledger.operators import evaluation as E
from deepledger.operators import reporting as R
from deepledger.plans import model_queries as M
from deepledger.plans import oracles as S
from deepledger.sources import adapters as A


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a file name and a size; some have neither index nor width, and one survey in three has frames of two sizes."""
    f = A.frames(spark, sf_dir)
    key = F.col("image_id")
    return f.withColumns({
        "filename": F.concat(F.lit("scan_"), (key % 1000).cast("string"), F.lit("_"), key.cast("string"), F.lit(".png")), "frame_index": F.when(key % 19 != 0, F.col("frame_index")),
        "width": F.when((F.col("survey_id") % 3 == 0) & (key % 2 == 0), 256).when(key % 4001 != 0, 512), "height": F.lit(A.IMAGE_HEIGHT),
    })


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target for each frame and class, with evidence as JSON that names its first detection; some have none, some a broken one."""
    rows = A.detections(spark, sf_dir).groupBy("survey_id", "image_id", "class_name").agg(F.min("detection_id").alias("d"), F.count("*").alias("n"))
    written = F.concat(F.lit('{"from_detection_id":"'), "d", F.lit('"}'))
    evidence = F.when(F.col("image_id") % 11 == 0, None).when(F.col("image_id") % 13 == 0, "{broken").otherwise(written)
    return rows.select("survey_id", F.concat_ws("_", F.lit("target"), "image_id", "class_name").alias("target_id"), "n", evidence.alias("evidence"))


def public_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.public_detections(A.detections(spark, sf_dir)).withColumnRenamed("class", "class_name")


def report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every survey's report, read back from its JSON."""
    surveys = A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("survey_id"), F.col("c_name").alias("name"))
    results = A.read(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderstatus").alias("status"))
    frames = _named(spark, sf_dir).select("survey_id", "image_id", "filename", "width", "height")
    rows = R.report_parts(surveys, frames, results, A.detections(spark, sf_dir).select("survey_id", "detection_id", "class_name"), _targets(spark, sf_dir))
    read = lambda path: F.get_json_object("body", path)
    shown = F.coalesce(read("$.name"), read("$.filename"), read("$.class_name"), read("$.n"))
    return rows.select("survey_id", "part", "part_id", shown.alias("shown"), read("$.result.status").alias("result"), F.get_json_object(read("$.evidence"), "$.from_detection_id").alias("evidence"))


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.markdown_lines(A.detections(spark, sf_dir))


def target_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.target_uncertainty(_targets(spark, sf_dir), A.detections(spark, sf_dir)).select("survey_id", "target_id", "from_detection_id", "uncertainty_m")


def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of many types and sizes."""
    key = F.col("o_orderkey")
    name = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("Frame_"), key.cast("string"), F.element_at(F.array(*map(F.lit, (".PNG", ".tif", ".txt", ".webp"))), (key % 4 + 1).cast("int"))))
    size = F.when(key % 5 == 0, 0).otherwise(F.floor("o_totalprice").cast("long") * 200)
    return A.read(spark, sf_dir, "orders").select(key.alias("file_id"), R.upload_fault(name, size).alias("fault"))


def calculator_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as requests, some stretched out of their ranges."""
    f = A.frames(spark, sf_dir)
    requests = f.select(
        "image_id", (F.col("vessel_lat") * 1.65).alias("latitude"), (F.col("vessel_lon") * 17.5).alias("longitude"), (F.col("heading_deg") * 1.01).alias("heading_deg"), "altitude_m",
        (F.col("range_m") - 45).alias("range_m"), (F.col("layback_m") - F.col("altitude_m") * 2).alias("layback_m"), (F.col("roll_deg") * 10).alias("roll_deg"), "pitch_deg",
    )
    return requests.select("image_id", F.array_join(R.calculator_faults(requests), "; ").alias("faults"))


def uniform_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.uniform_dimensions(_named(spark, sf_dir))


def frame_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordered_frames(_named(spark, sf_dir)).select("survey_id", "image_id", "place")


def chronological_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chronological_tail(_named(spark, sf_dir), "survey_id").select("survey_id", "image_id", "tail")


def classes_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.classes_by_count(A.detections(spark, sf_dir))


def class_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.class_sets(A.detections(spark, sf_dir), ("wreck", "debris", "structure"), ("tire",))


def image_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _named(spark, sf_dir).select("image_id", "filename")
    sites = A.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.min("l_returnflag").alias("site")).where("site < 'N'")
    return R.sites_of(f, sites)


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_threshold(E.threshold_sweep(M._scored(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        public_detections, report_parts, markdown_report, target_uncertainty, upload_checks, calculator_checks, uniform_dimensions, frame_order, chronological_tail, classes_by_count, class_sets,
        image_sites, best_threshold,
    )
}

_NAMED = A.FRAMES + """, named as (select * exclude (frame_index), case when image_id % 19 <> 0 then frame_index end as frame_index, 'scan_' || image_id % 1000 || '_' || image_id || '.png' as filename,
    case when survey_id % 3 = 0 and image_id % 2 = 0 then 256 when image_id % 4001 <> 0 then 512 end as width, 512 as height from frames)"""
_TARGETS = A.DETECTIONS + """, targets as (select survey_id, 'target_' || image_id || '_' || class_name as target_id, count(*) as n,
    case when image_id % 11 <> 0 and image_id % 13 <> 0 then min(detection_id) end as from_detection_id from detections group by survey_id, image_id, class_name)"""
_ENDS = " or ".join(f"n like '%{t}'" for t in R.IMAGE_TYPES)


def _range(name: str, value: str, good: str, required: bool = False) -> str:
    missing = f"when {value} is null then '{name} missing' " if required else ""
    return f"case {missing}when not ({good.replace('?', value)}) then '{name} out of range' end"


_FAULTS = ", ".join((
    _range("latitude", "vessel_lat * 1.65::double", "? between -90 and 90", True), _range("longitude", "vessel_lon * 17.5::double", "? between -180 and 180", True),
    _range("heading_deg", "heading_deg * 1.01::double", "? between 0 and 360", True), _range("altitude_m", "altitude_m", "? > 0", True), _range("range_m", "(range_m - 45)", "? > 0"),
    _range("layback_m", "(layback_m - altitude_m * 2)", "? >= 0"), _range("roll_deg", "roll_deg * 10", "? between -45 and 45"), _range("pitch_deg", "pitch_deg", "? between -45 and 45"),
))

ORACLES = {
    "public_detections": f"""with {S.SCORED} select detection_id as id, class_name, round(x, 1) as bbox_x, round(y, 1) as bbox_y, round(w, 1) as bbox_w, round(h, 1) as bbox_h, round(class_confidence, 3) as yolo_confidence,
        round({S.BELL}, 3) as segmentation_score, round(coalesce(natural_, 0.5::double), 3) as artificial_probability, shadow as shadow_score, physics as geometry_score, fusion as final_confidence, status as decision,
        lat is not null as known, case when lat is not null then 'approximate' else 'unknown' end as location, lat, lon, uncertainty_m, priority, tier from scored""",
    "report_parts": f"""with {_TARGETS}, {_NAMED.removeprefix(A.FRAMES + ", ")}
        select c_custkey as survey_id, 'survey' as part, c_custkey::varchar as part_id, c_name as shown, null as result, null as evidence from customer
        union all select survey_id, 'image', image_id::varchar, filename, nullif(o_orderstatus, 'O'), null from named join orders on o_orderkey = image_id
        union all select survey_id, 'detection', detection_id, class_name, null, null from detections
        union all select survey_id, 'target', target_id, n::varchar, null, from_detection_id from targets""",
    "markdown_report": f"""with {S.SCORED}, t as (select survey_id, count(*) as n, count(lat) as located, count(*) filter (tier in ('high', 'critical')) as urgent from scored group by 1)
        select survey_id, 0 as line_no, '# Survey ' || survey_id as line from t union all select survey_id, 1, printf('%d detections, %d located, %d of high or critical priority', n, located, urgent) from t
        union all select survey_id, 2, '| rank | detection | class | status | tier |' from t union all select survey_id, 3, '|---|---|---|---|---|' from t
        union all select survey_id, 3 + k, '| ' || concat_ws(' | ', k, detection_id, class_name, status, tier) || ' |' from (select *, row_number() over (partition by survey_id order by priority desc, detection_id) as k from scored)""",
    "target_uncertainty": f"with {_TARGETS} select t.survey_id, target_id, from_detection_id, uncertainty_m from targets t left join detections on detection_id = from_detection_id",
    "upload_checks": f"""with f as (select o_orderkey as file_id, case when o_orderkey % 7 = 0 then '' else lower('Frame_' || o_orderkey || ['.PNG', '.tif', '.txt', '.webp'][1 + o_orderkey % 4]) end as n,
        case when o_orderkey % 5 = 0 then 0 else floor(o_totalprice)::bigint * 200 end as size from orders)
        select file_id, case when n = '' then 'file has no name' when not ({_ENDS}) then 'unsupported file type' when size = 0 then 'empty file' when size > 52428800 then 'file exceeds 50 MB limit' end as fault from f""",
    "calculator_checks": f"with {A.FRAMES} select image_id, array_to_string(list_filter([{_FAULTS}], lambda x: x is not null), '; ') as faults from frames",
    "uniform_dimensions": f"with {_NAMED} select survey_id, count(distinct (coalesce(width, -1), height)) = 1 as uniform from named group by 1",
    "frame_order": f"with {_NAMED} select survey_id, image_id, row_number() over (partition by survey_id order by frame_index nulls first, filename, image_id) as place from named",
    "chronological_tail": f"with {_NAMED} select survey_id, image_id, row_number() over (partition by survey_id order by filename, image_id) > floor(count(*) over (partition by survey_id) * 0.85::double) as tail from named",
    "classes_by_count": f"with {A.DETECTIONS}, c as (select class_name, count(*) as n from detections group by 1) select class_name, n, row_number() over (order by n desc, class_name) as place from c",
    "class_sets": f"""with {A.DETECTIONS}, c as (select image_id, string_agg(distinct class_name, ',' order by class_name) as classes, bool_or(class_name = 'tire') as bad from detections group by 1)
        select image_id, classes, not bad as within, not bad as disjoint, case when bad then 'tire' else '' end as found from c""",
    "image_sites": f"""with {_NAMED}, s as (select l_orderkey as image_id, min(l_returnflag) as site from lineitem group by 1 having min(l_returnflag) < 'N')
        select image_id, filename, coalesce(site, 'scan_' || image_id % 1000 || '_' || image_id) as site from named left join s using (image_id)""",
    "best_threshold": f"with sweep as ({M.ORACLES['threshold_sweep']}) select threshold, f1 from sweep order by coalesce(f1, 0) desc, threshold limit 1",
}
