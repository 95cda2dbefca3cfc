"""Queries over association, evaluation, data sets, images and text fields, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deepledger.functions import constants as K
from deepledger.functions import scores
from deepledger.functions import text as T
from deepledger.operators import association as X
from deepledger.operators import detections as D
from deepledger.operators import evaluation as E
from deepledger.operators import fitting
from deepledger.operators import images as I
from deepledger.plans import oracles as S
from deepledger.sources import adapters as A


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as classifier output: truth, a score in thousandths of the length, and the source as site."""
    d = A.read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    rows = A.read(spark, sf_dir, "labels").join(d, "doc_id")
    return rows.select(F.col("doc_id").alias("image_id"), F.col("source").alias("site"), F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / 1000).alias("confidence"))


SCORED_LABELS = "labelled as (select doc_id as image_id, source as site, quality as label, (n_chars % 1000) / 1000 as confidence from labels join documents using (doc_id))"


def association_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.associate(A.detections(spark, sf_dir))


def association_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.summary(X.associate(A.detections(spark, sf_dir)))


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Detections with a score, and as truths their copies shifted by a few pixels where a part's number is even."""
    d = A.detections(spark, sf_dir)
    found = d.select("image_id", "detection_id", "x", "y", "w", "h", F.col("class_confidence").alias("score"))
    shift = (F.col("x") % 5).cast("double")
    truths = d.where(F.col("y") % 2 == 0).select("image_id", F.col("detection_id").alias("truth_id"), (F.col("x") + shift).alias("x"), F.col("y"), "w", "h")
    return found, truths


def greedy_match_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.precision_recall(E.greedy_match(*pairs(spark, sf_dir)))


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.suppress(pairs(spark, sf_dir)[0])


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration_bins(_scored(spark, sf_dir))


def expected_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration_error(_scored(spark, sf_dir))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roc_auc(_scored(spark, sf_dir))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.threshold_sweep(_scored(spark, sf_dir))


def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier scores through a logistic curve, four times as steep about 0.5 and moved down by 0.2."""
    return _scored(spark, sf_dir).select("image_id", F.round(scores.calibrated(F.col("confidence"), 4.0, -0.2), 6).alias("score"))


def fusion_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion weights, intercept and gain fitted to all detections, of which those count as confirmed whose class confidence and natural score reach 1 together."""
    d = A.detections(spark, sf_dir).withColumn("label", (F.col("class_confidence") + F.col("natural") >= 1).cast("double"))
    found = fitting.fit_fusion(d.select(*[v.alias(k) for k, v in D.signals(d).items()], "label"))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "parameter string, value double")


def dice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.pixels_of(A.read(spark, sf_dir, "embeddings"))
    return E.dice(p.select("image_id", (F.col("v") > 128).cast("int").alias("predicted"), ((F.col("v") + F.col("row")) > 131).cast("int").alias("truth")))


def site_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.site_split(_scored(spark, sf_dir)).select("image_id", "site", "split")


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.split_report(E.site_split(_scored(spark, sf_dir)))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.detections(spark, sf_dir)
    cid = F.when(F.col("class_name") == "wreck", 0).when(F.col("class_name") == "debris", 1).when(F.col("class_name") == "structure", 2).otherwise(3)
    return d.select("image_id", cid.alias("class_id"), "x", "y", "w", "h")


def yolo_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's label text."""
    return E.label_lines(_boxes(spark, sf_dir), 512.0, 512.0).select("image_id", "boxes", "lines")


def label_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).groupBy("class_id").agg(F.count("*").alias("boxes"), F.count_distinct("image_id").alias("images"))


def label_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the exported lines: boxes that reach over the image's side are out of range only by their centre."""
    lines = _boxes(spark, sf_dir).select("image_id", F.concat_ws(" ", (F.col("class_id") + F.when(F.col("x") > 390, 2).otherwise(0)).cast("string"), *[F.format_string("%.6f", F.col(c) / 400) for c in "xywh"]).alias("line"))
    return E.label_faults(lines).groupBy("fault").agg(F.count("*").alias("n"))


def label_image_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without a label and labels without a frame."""
    frames = A.frames(spark, sf_dir).select("image_id")
    labels = A.read(spark, sf_dir, "lineitem").where("l_linenumber <> 3").select(F.col("l_orderkey").alias("image_id"))
    return E.unmatched(frames, labels)


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = A.frames(spark, sf_dir).withColumnsRenamed({"vessel_lat": "lat", "vessel_lon": "lon"})
    return I.quality(I.pixels_of(A.read(spark, sf_dir, "embeddings")), meta)


def shadow_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dark_run(I.pixels_of(A.read(spark, sf_dir, "embeddings")))


def sparse_bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.robust_bright(I.pixels_of(A.read(spark, sf_dir, "embeddings")))


def anomaly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.distance_anomaly(A.read(spark, sf_dir, "embeddings"))


def telemetry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay text written from events and read back: two numbers, a time and a coordinate."""
    e = A.read(spark, sf_dir, "events").select("event_id", "value", "ts")
    minutes = F.format_string("%02d %06.3f N", (F.col("event_id") % 90).cast("int"), F.col("value") % 60)
    shown = F.concat(F.lit("HDG: "), (F.col("event_id") % 360).cast("string"), F.lit("  ALT "), F.format_string("%.2f", F.col("value")), F.lit(" m  RNG=50"))
    e = e.withColumns({"shown": shown, "spot": minutes, "stamp": F.date_format("ts", "yyyy:MM:dd HH:mm:ss")})
    t = T.telemetry(F.col("shown"))
    return e.select("event_id", t["heading_deg"].alias("heading_deg"), F.round(t["altitude_m"], 2).alias("altitude_m"), t["range_m"].alias("range_m"), F.round(T.coordinate(F.col("spot")), 6).alias("lat"), F.unix_seconds(T.timestamp(F.col("stamp"))).alias("seconds"))


def class_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types mapped to the taxonomy by their last word; tin is excluded and other names are debris."""
    word = F.lower(F.substring_index("p_type", " ", -1))
    mapped = F.when(word == "steel", "wreck").when(word == "brass", "structure").when(word == "nickel", "tire").otherwise("debris")
    return A.read(spark, sf_dir, "part").where(word != "tin").groupBy(mapped.alias("class_name")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        association_fold, association_summary, greedy_match_prf, nms, calibration_bins, expected_calibration_error, roc_auc, threshold_sweep, calibrated_scores, fusion_fit, dice_scores, site_split, split_report, yolo_export,
        label_census, label_purity, label_image_check, image_quality, shadow_run, sparse_bright, anomaly_score, telemetry_fields, class_mapping,
    )
}

_FITTED = {f"w_{k}": v for k, v in S.SIGNALS.items() if k != "consistency"}  # which these rows do not have, so that its weight stays 0
_LINEAR = "(f.intercept + " + " + ".join(f"f.{k} * s.{k}" for k in _FITTED) + ")"
#: All steps as a recursion over the different rows, each with its frequency.
_FIT = f"""with recursive {A.DETECTIONS}, signals as (select {", ".join(f"coalesce(({v})::double, 0) as {k}" for k, v in _FITTED.items())}, (class_confidence + natural_ >= 1)::int::double as label, count(*)::double as times from detections group by all),
    rows_ as (select sum(times) as n from signals),
    fit as (select 0 as step, {", ".join(f"0::double as {k}" for k in _FITTED)}, 0::double as intercept, 1::double as gain
        union all select step + 1, {", ".join(f"{k} - 0.5::double * d_{k} / n" for k in _FITTED)}, intercept - 0.5::double * d_intercept / n, gain - 0.5::double * d_gain / n
        from (select step, {", ".join(f"{k}" for k in _FITTED)}, intercept, gain, {", ".join(f"sum(slope * x_{k}) as d_{k}" for k in _FITTED)}, sum(slope) as d_intercept, sum(slope * linear) as d_gain
            from (select *, (p - label) * p * (1 - p) * times as slope from (select f.*, label, times, {", ".join(f"s.{k} as x_{k}" for k in _FITTED)}, {_LINEAR} as linear, 1 / (1 + exp(-greatest(-30::double, least(30::double, f.gain * {_LINEAR})))) as p from fit f, signals s where f.step < 400)) group by all), rows_)
    select unnest(['{"', '".join([*[k[2:] for k in _FITTED], "consistency", "intercept", "gain"])}']) as parameter, unnest([{", ".join(f"round({k}, 6)" for k in [*_FITTED, "0::double", "intercept", "gain"])}]) as value from fit where step = 400"""
_CID = "case class_name when 'wreck' then 0 when 'debris' then 1 when 'structure' then 2 else 3 end"
PIXELS = """raw as (select vec_id, unnest(embedding) as x, unnest(range(0, len(embedding))) as i from embeddings),
    pixels as (select vec_id // 8 as image_id, vec_id % 8 as "row", i as col, greatest(0, least(255, floor(128 + x::double * 32)))::int as v from raw)"""
_SPLIT = SCORED_LABELS + """, sites as (select distinct site from labelled), ranked as (select site, row_number() over (order by md5('0|' || site), site) as k, count(*) over () as n from sites),
    parts as (select site, case when k <= greatest(1, floor(0.2 * n + 0.5)) then 'val' else 'train' end as split from ranked), divided as (select * from labelled join parts using (site))"""
_BINS = SCORED_LABELS + ", bins as (select greatest(0, ceil(confidence * 10) - 1)::int as bin, count(*) as n, avg(confidence) as c, avg(label) as a from labelled group by 1)"

def _iou(a: str, b: str) -> str:
    """Overlap of two boxes, structs x, y, w, h."""
    inner = f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    return f"({inner} / greatest({a}.w * {a}.h + {b}.w * {b}.h - {inner}, 1e-9::double))"


#: Detections of an image by descending score, one at each step.
_RANKED = f"""recursive {A.DETECTIONS}, found as (
    select image_id, detection_id, {{'x': x, 'y': y, 'w': w, 'h': h}} as box, row_number() over (partition by image_id order by class_confidence desc, detection_id) as k from detections)"""
_NMS = f"""{_RANKED}, steps as (
    select image_id, 0::bigint as k, []::struct(id varchar, box struct(x double, y double, w double, h double))[] as kept from (select distinct image_id from found)
    union all
    select s.image_id, f.k, case when coalesce(list_bool_or(list_transform(kept, lambda b: {_iou('b.box', 'f.box')} > 0.45::double)), false) then kept else list_append(kept, {{'id': f.detection_id, 'box': f.box}}) end
    from steps s join found f on f.image_id = s.image_id and f.k = s.k + 1)"""
MATCHED = f"""{_RANKED}, truths as (select image_id, list({{'x': x + x % 5, 'y': y, 'w': w, 'h': h}} order by detection_id) as boxes from detections where y % 2 = 0 group by 1),
    steps as (
        select image_id, 0::bigint as k, coalesce(boxes, []) as boxes, []::bigint[] as used from (select distinct image_id from found) left join truths using (image_id)
        union all
        select image_id, k, boxes, case when list_max(free) >= 0.5::double then list_append(used, list_position(free, list_max(free))) else used end from (
            select s.image_id, f.k, boxes, used, list_transform(boxes, lambda b, i: case when list_contains(used, i) then -1::double else {_iou('f.box', 'b')} end) as free
            from steps s join found f on f.image_id = s.image_id and f.k = s.k + 1)),
    ends as (select image_id, arg_max(len(used), k) as tp, max(k) as n, any_value(len(boxes)) as truths from steps group by 1)"""
_W, _ONE = K.ASSOCIATION_WEIGHTS, "1.0::double"
#: The fold of each survey in frame order, a detection at each step, with the live targets as a list.
_FOLDED = f"""recursive {A.DETECTIONS}, ordered as (select *, row_number() over (partition by survey_id order by frame_index, image_id, detection_id) as k from detections),
    folded as (
        select survey_id, 0::bigint as k, null::varchar as detection_id, null::varchar as target_id, null::varchar as decision, null::double as score, {{'id': null::varchar, 'score': null::double, 'c': null::double, 'g': null::double, 'f': null::double, 's': null::double}} as best,
            []::struct(id varchar, cls varchar, lat double, lon double, own varchar, x double, y double, w double, h double, "last" double)[] as live from (select distinct survey_id from ordered)
        union all
        select survey_id, k, detection_id, case decision when 'accepted' then best.id when 'new_target' then fresh end, decision, best.score, best,
            case decision when 'ambiguous' then live when 'new_target' then list_append(live, {{'id': fresh, 'cls': class_name, 'lat': lat, 'lon': lon, 'own': detection_id, 'x': x, 'y': y, 'w': w, 'h': h, 'last': frame_index::double}})
                else list_transform(live, lambda t: case when t.id <> best.id then t else {{'id': t.id, 'cls': t.cls, 'lat': case when lat is null then t.lat else lat end, 'lon': case when lat is null then t.lon else lon end, 'own': least(t.own, detection_id),
                    'x': case when detection_id < t.own then x else t.x end, 'y': case when detection_id < t.own then y else t.y end, 'w': case when detection_id < t.own then w else t.w end, 'h': case when detection_id < t.own then h else t.h end, 'last': greatest(t.last, frame_index::double)}} end) end
        from (select *, 'tgt_' || substr(sha256(survey_id || '|' || detection_id), 1, 12) as fresh, case when coalesce(best.score, 0) < {K.ACCEPT} then 'new_target' when round(best.score - coalesce(second, -1), 4) < {K.AMBIGUITY} then 'ambiguous' else 'accepted' end as decision
            from (select *, list_max(list_transform(list_filter(scored, lambda t: t.id <> best.id), lambda t: t.score)) as second
                from (select *, list_reduce(list_append(scored, {{'id': null::varchar, 'score': null::double, 'c': null::double, 'g': null::double, 'f': null::double, 's': null::double}}), lambda a, b: case when b.score > a.score or b.score = a.score and b.id < a.id then b else a end) as best
                    from (select * exclude (near), list_transform(near, lambda t: {{'id': t.id, 'score': round_even(({_W['class']}::double * t.same + {_W['geographic']}::double * coalesce({S.ramp('t.dist', *K.DISTANCE_RAMP)}, 0) + {_W['frame']}::double * {S.ramp('t.gap', *K.FRAME_RAMP)} + {_W['spatial']}::double * {S.ramp('1 - t.ov', *K.OVERLAP_RAMP)})
                                / ({_W['class']}::double + case when t.dist is null then 0 else {_W['geographic']}::double end + {_W['frame']}::double + {_W['spatial']}::double)
                                * case when t.same = 1 then {_ONE} else {K.CLASS_PENALTY}::double end * case when round(t.dist, 1) > {K.DISTANCE_RAMP[1]} then {K.GEO_PENALTY}::double else {_ONE} end * case when round(t.ov, 3) <= 0 and t.gap <= 1 then {K.SPATIAL_PENALTY}::double else {_ONE} end, 4),
                            'c': t.same::double, 'g': {S.ramp('t.dist', *K.DISTANCE_RAMP)}, 'f': {S.ramp('t.gap', *K.FRAME_RAMP)}, 's': {S.ramp('1 - t.ov', *K.OVERLAP_RAMP)}}}) as scored
                        from (select o.*, live, list_transform(live, lambda t: {{'id': t.id, 'same': (t.cls = o.class_name)::int, 'dist': case when t.lat is not null and o.lat is not null then {S.haversine('t.lat', 't.lon', 'o.lat', 'o.lon')} end, 'gap': abs(t.last - o.frame_index), 'ov': {_iou('t', 'o')}}}) as near
                            from folded f join ordered o on o.survey_id = f.survey_id and o.k = f.k + 1))))))"""

ORACLES = {
    "nms": f"with {_NMS}, ends as (select image_id, arg_max(kept, k) as kept from steps group by 1) select image_id, unnest(list_transform(kept, lambda b: b.id)) as detection_id from ends",
    "greedy_match_prf": f"""with {MATCHED}, t as (select sum(tp)::bigint as tp, sum(n - tp)::bigint as fp, sum(truths - tp)::bigint as fn, count(*) as images, count(*) filter (n > tp) as images_with_fp from ends), r as (select *, tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as q from t)
        select tp, fp, fn, images, images_with_fp, round(coalesce(p, 0), 4) as precision, round(coalesce(q, 0), 4) as recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 4) as f1, round(fp / images, 4) as fp_per_image from r""",
    "association_fold": f"with {_FOLDED} select survey_id, detection_id, target_id, decision, score, round(best.c, 3) as class_score, round(best.g, 3) as geographic_score, round(best.f, 3) as frame_score, round(best.s, 3) as spatial_score from folded where k > 0",
    "association_summary": f"""with {_FOLDED} select survey_id, count(*) as detections, count(distinct target_id) as targets, count(*) filter (decision = 'accepted') as accepted, count(*) filter (decision = 'ambiguous') as ambiguous,
        count(*) filter (decision = 'new_target') as founded, 0::bigint as reused from folded where k > 0 group by 1""",
    "calibration_bins": f"with {_BINS} select bin, n, round(c, 6) as confidence, round(a, 6) as accuracy, round(abs(c - a), 6) as gap from bins",
    "expected_calibration_error": f"with {_BINS} select sum(n)::bigint as n, round(sum(round(abs(c - a), 6) * n) / sum(n), 5) as ece from bins",
    "roc_auc": f"""with {SCORED_LABELS}, p as (select sum(case when a.confidence > b.confidence then 1.0::double when a.confidence = b.confidence then 0.5::double else 0 end) as u from labelled a, labelled b where a.label = 1 and b.label = 0)
        select sum(label)::bigint as positives, sum(1 - label)::bigint as negatives, round((select u from p) / (sum(label) * sum(1 - label)), 6) as auc from labelled""",
    "calibrated_scores": f"with {SCORED_LABELS} select image_id, round(1 / (1 + exp(-(4 * (confidence - 0.5) - 0.2)::double)), 6) as score from labelled",
    "fusion_fit": _FIT,
    "threshold_sweep": f"""with {SCORED_LABELS}, t as (select unnest(range(0, 21)) as k), c as (select k, count(*) filter (least(20, floor(confidence * 20)) >= k and label = 1) as tp, count(*) filter (least(20, floor(confidence * 20)) >= k and label = 0) as fp, sum(label)::bigint as p, sum(1 - label)::bigint as q from t, labelled group by k)
        select round(k / 20, 4) as threshold, tp, fp, p - tp as fn, round(2 * tp / nullif(tp + fp + p, 0), 6) as f1, round((tp + q - fp) / (p + q), 6) as accuracy, round((tp / p + (q - fp) / q) / 2, 6) as balanced from c""",
    "dice_scores": f"""with {PIXELS}, m as (select image_id, (v > 128)::int as p, (v + "row" > 131)::int as t from pixels), s as (select image_id, sum(p * t) as i, sum(p) as p, sum(t) as t from m group by 1)
        select round(2 * sum(i) / (sum(p) + sum(t)), 6) as pooled_dice, round(sum(i) / (sum(p) + sum(t) - sum(i)), 6) as pooled_iou, round(avg(case when p + t = 0 then 1 else 2 * i / (p + t) end), 6) as mean_dice, count(*) as images from s""",
    "site_split": f"with {_SPLIT} select image_id, site, split from divided",
    "split_report": f"with {_SPLIT} select split, count(*) as n, sum(label)::bigint as positives, count(distinct site) as sites, round((count(*) - sum(label)) / sum(label), 6) as positive_weight from divided group by 1",
    "yolo_export": f"""with {A.DETECTIONS}, l as (select image_id, {_CID} || ' ' || printf('%.6f %.6f %.6f %.6f', (x + w / 2) / 512, (y + h / 2) / 512, w / 512, h / 512) as line from detections)
        select image_id, count(*) as boxes, string_agg(line, chr(10) order by line) as lines from l group by 1""",
    "label_census": f"with {A.DETECTIONS} select {_CID} as class_id, count(*) as boxes, count(distinct image_id) as images from detections group by 1",
    "label_purity": f"""with {A.DETECTIONS}, f as (select case when {_CID} + case when x > 390 then 2 else 0 end > 3 then 'class id' when greatest(x, y, w, h) / 400 > 1 then 'coordinate range' end as fault from detections) select fault, count(*) as n from f where fault is not null group by 1""",
    "label_image_check": """with l as (select distinct l_orderkey as image_id from lineitem where l_linenumber <> 3) select o_orderkey as image_id, 'no label' as what from orders where o_orderkey not in (select image_id from l)
        union all select image_id, 'no frame' from l where image_id not in (select o_orderkey from orders)""",
    "image_quality": f"""with {PIXELS}, {A.FRAMES}, s as (select *, abs(v - lag(v) over (partition by image_id, "row" order by col)) as step from pixels),
        a as (select image_id, avg(v) as mean, stddev_pop(v) as sd, (quantile_cont(v, 0.98) - quantile_cont(v, 0.02)) / 256 as contrast, avg(step) + 1e-6 as noise, avg((v < 24)::int) as dark, avg((v > 232)::int) as bright, count(*) as n from s group by 1),
        b as (select image_id, v // 4 as bin, count(*) as k from pixels group by all), e as (select image_id, -sum(k / n * log2(k / n)) as entropy from b join a using (image_id) group by 1),
        c as (select image_id, ((vessel_lat is not null and vessel_lon is not null)::int + (heading_deg is not null)::int + (altitude_m is not null)::int + (range_m is not null)::int + (side in ('port', 'starboard'))::int) / 5 as complete from frames)
        select image_id, round(mean, 2) as mean, round(sd, 2) as sd, round(contrast, 4) as contrast, round(noise, 3) as noise, round(entropy, 3) as entropy, round(dark, 4) as dark, round(bright, 4) as bright,
            array_to_string(list_filter([case when contrast < 0.08 then 'low_contrast' end, case when noise > 40 then 'high_noise' end, case when dark > 0.9 then 'all_dark' end, case when bright > 0.9 then 'all_bright' end, case when mean < 5 or mean > 250 then 'degenerate_range' end], lambda x: x is not null), ',') as flags,
            round(20.0::double * case when dark > 0.9 or bright > 0.9 then 0 else 1 end + 30 * least(1.0::double, contrast / 0.35::double) + 20 * greatest(0.0::double, 1 - noise / 60) + 30 * coalesce(complete, 0), 1) as score from a join e using (image_id) left join c using (image_id)""",
    "shadow_run": f"""with {PIXELS}, m as (select image_id, avg(v) as m, stddev_pop(v) as s from pixels group by 1), p as (select image_id, "row", avg(v) as p from pixels group by all),
        d as (select image_id, "row", "row" - row_number() over (partition by image_id order by "row") as island from p join m using (image_id) where p < m - 1.5::double * s), r as (select image_id, island, min("row") as start_row, count(*) as length from d group by all)
        select image_id, min(start_row) as start_row, arg_min(length, start_row) as length from r group by 1""",
    "sparse_bright": f"""with {PIXELS}, m as (select image_id, median(v) as med from pixels group by 1), o as (select p.*, med, abs(v - med) as off from pixels p join m using (image_id)), d as (select image_id, greatest(4.0::double, 1.4826::double * median(off)) as mad, count(*) as n from o group by 1)
        select image_id, round(avg((n >= 200 and v > med + 3 * mad)::int), 6) as bright_share from o join d using (image_id) group by 1""",
    "anomaly_score": """with x as (select vec_id, label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as i from embeddings), c as (select i, avg(x) as c from x where label = 0 group by 1),
        d as (select vec_id, label, sqrt(sum(pow(x - c, 2))) as d from x join c using (i) group by 1, 2), b as (select median(d) as b from d where label = 0)
        select vec_id, round(greatest(0.0::double, least(1.0::double, (d - b) / (6 * b))), 6) as score from d, b""",
    "telemetry_fields": "select event_id, (event_id % 360)::double as heading_deg, round(value, 2) as altitude_m, 50.0::double as range_m, round(event_id % 90 + round(value % 60, 3) / 60, 6) as lat, epoch_us(ts) // 1000000 as seconds from events",
    "class_mapping": "with t as (select lower(list_extract(string_split(p_type, ' '), -1)) as w from part) select case w when 'steel' then 'wreck' when 'brass' then 'structure' when 'nickel' then 'tire' else 'debris' end as class_name, count(*) as n from t where w <> 'tin' group by 1",
}
