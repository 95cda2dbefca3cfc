"""DuckDB SQL fragments that several oracles share."""

from deepledger.functions import constants as K
from deepledger.sources.adapters import DETECTIONS, FRAME_SIZES

#: Fixed values as SQL.
BELL = "(case when mask_frac is null then 0.5::double when mask_frac < 0.03 then 0.1 when mask_frac < 0.20 then 0.1::double + 0.9::double * (mask_frac - 0.03::double) / 0.17::double when mask_frac <= 0.65 then 1.0 when mask_frac < 0.95 then 1.0::double - 0.7::double * (mask_frac - 0.65::double) / 0.30::double else 0.2 end)"
SIGNALS = {"detection": "class_confidence", "segmentation": BELL, "natural": "natural_", "shadow": "shadow", "physics": "physics", "consistency": "null::double"}


def used_of(signals: dict[str, str]) -> str:
    return "nullif(" + " + ".join(f"case when {v} is null then 0 else {K.FUSION_WEIGHTS[k]}::double end" for k, v in signals.items()) + ", 0)"


def fusion_of(signals: dict[str, str]) -> str:
    mean = "((" + " + ".join(f"coalesce({v} * {K.FUSION_WEIGHTS[k]}::double, 0)" for k, v in signals.items()) + f") / {used_of(signals)})"
    return f"coalesce(round(1 / (1 + exp(-{K.GAIN}::double * ({K.INTERCEPT}::double + {mean}))), 4), 0)"


FUSION = fusion_of(SIGNALS)


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {K.EARTH_RADIUS_M}::double * asin(sqrt(least(1.0::double, {a}))))"


def pmod360(x: str) -> str:
    return f"(({x}) - 360 * floor(({x}) / 360))"


def iou(a: str, b: str) -> str:
    inner = f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    return f"(case when {a}.w * {a}.h + {b}.w * {b}.h - {inner} > 0 then {inner} / ({a}.w * {a}.h + {b}.w * {b}.h - {inner}) else 0 end)"


def ramp(x: str, full: float, none: float) -> str:
    return f"(case when ({x}) is not null then greatest(0.0::double, least(1.0::double, ({none} - ({x})) / {none - full}::double)) end)"


def risk(part: int) -> str:
    return "(case class_name " + " ".join(f"when '{k}' then {v[part]}::double" for k, v in K.RISKS.items()) + f" else {K.RISKS['unknown'][part]}::double end)"


OVERLAPS = DETECTIONS + f""", {FRAME_SIZES}, sized as (select * from detections join sizes using (image_id)),
    overlapping as (select a.survey_id, a.detection_id as first_id, b.detection_id as second_id, round({iou('a', 'b')}, 4) as overlap
        from sized a join sized b on a.survey_id = b.survey_id and a.image_id <> b.image_id and a.detection_id < b.detection_id and a.width is not distinct from b.width and a.height is not distinct from b.height
        where (a.lat is null or b.lat is null) and round({iou('a', 'b')}, 4) >= {K.CONSISTENCY_OVERLAP})"""
#: detections with what other frames say of them.
CONSISTENT = OVERLAPS + f""", spots as (select survey_id, image_id, lat, lon, count(*) as k from detections where lat is not null group by all),
    near as (select a.survey_id, a.image_id, a.lat, a.lon, sum(b.k) as places from spots a join spots b on a.survey_id = b.survey_id and a.image_id <> b.image_id where {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {K.CONSISTENCY_M} group by all),
    beside as (select detection_id, count(*) as boxes from (select first_id as detection_id from overlapping union all select second_id from overlapping) group by 1),
    held as (select survey_id, count(distinct image_id) as frames from detections group by 1),
    viewed as (select d.*, frames > 1 as available, (coalesce(places, 0) + coalesce(boxes, 0))::bigint as views from detections d join held using (survey_id) left join near using (survey_id, image_id, lat, lon) left join beside using (detection_id)),
    consistent as (select *, case when available then round(least(1.0::double, views / 2), 3) end as consistency from viewed)"""
_SIZE = "round(least(1.0::double, greatest(w / 4, h / 4) / 20), 3)"
def scored(source: str, fusion: str) -> str:
    """CTEs that give `source` its fusion, status, priority and tier, as table scored."""
    return f""", fused as (select *, {fusion} as fusion from {source}),
    ranked as (select *, case when anomaly >= 0.8 and class_confidence < 0.6 then 'human_review_required' when fusion >= {K.CONFIRM} then 'confirmed' when fusion >= {K.REVIEW} then 'review' else 'candidate' end as status,
        floor((round({risk(0)} * 1000) * 20 + round({_SIZE} * 1000) * 10 + round({risk(1)} * 1000) * 25 + round({risk(2)} * 1000) * 20 + floor((round(fusion * 10000) + 5) / 10) * 15 + 500 * 10 + 50) / 100) / 10 as priority from fused),
    scored as (select *, case when priority >= 80 then 'critical' when priority >= 60 then 'high' when priority >= 40 then 'medium' else 'low' end as tier from ranked)"""


SCORED = DETECTIONS + scored("detections", FUSION)
SCORED_CONSISTENT = CONSISTENT + scored("consistent", fusion_of(SIGNALS | {"consistency": "consistency"}))


def geodesic(source: str, name: str, lat: str, lon: str, bearing: str, distance: str) -> str:
    """CTEs that give `source` the columns {name}_lat and {name}_lon, as table {name}."""
    f, a = K.WGS84_F, K.WGS84_A
    b = a * (1 - f)
    step = "cos(s) * (2 * pow(cos(2 * _arc + s), 2) - 1) - _b / 6 * cos(2 * _arc + s) * (4 * pow(sin(s), 2) - 3) * (4 * pow(cos(2 * _arc + s), 2) - 3)"
    lost = f"(1 - _c) * {f}::double * _sa * (_s + _c * sin(_s) * (_m + _c * cos(_s) * (2 * _m * _m - 1)))"
    wrapped = pmod360(f"{lon} + degrees(atan2(sin(_s) * sin(_az), cos(_u) * cos(_s) - sin(_u) * sin(_s) * cos(_az)) - {lost}) + 540")
    return f"""{name}_1 as (select *, radians({bearing}) as _az, atan((1 - {f}::double) * tan(radians({lat}))) as _u, {distance} as _d from {source}),
  {name}_2 as (select *, atan2(tan(_u), cos(_az)) as _arc, cos(_u) * sin(_az) as _sa from {name}_1),
  {name}_3 as (select *, (1 - _sa * _sa) as _ca, (1 - _sa * _sa) * {(a * a - b * b) / (b * b)!r}::double as _q from {name}_2),
  {name}_4 as (select *, _d / ({b!r}::double * (1 + _q / 16384 * (4096 + _q * (-768 + _q * (320 - 175 * _q))))) as _first, _q / 1024 * (256 + _q * (-128 + _q * (74 - 47 * _q))) as _b, {f}::double / 16 * _ca * (4 + {f}::double * (4 - 3 * _ca)) as _c from {name}_3),
  {name}_5 as (select *, list_reduce([0, 1, 2, 3, 4, 5]::double[], lambda s, i: _first + _b * sin(s) * (cos(2 * _arc + s) + _b / 4 * ({step})), _first) as _s from {name}_4 where _d is not null and _u is not null and _az is not null
        union all select *, null from {name}_4 where _d is null or _u is null or _az is null),
  {name}_6 as (select *, cos(2 * _arc + _s) as _m, sin(_u) * sin(_s) - cos(_u) * cos(_s) * cos(_az) as _x from {name}_5),
  {name} as (select * exclude (_az, _u, _d, _arc, _sa, _ca, _q, _first, _b, _c, _s, _m, _x),
        case when _d <= 0 then {lat} else degrees(atan2(sin(_u) * cos(_s) + cos(_u) * sin(_s) * cos(_az), (1 - {f}::double) * sqrt(_sa * _sa + _x * _x))) end as {name}_lat,
        case when _d <= 0 then {lon} else {wrapped} - 180 end as {name}_lon from {name}_6)"""
