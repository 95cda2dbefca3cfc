import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from deepledger.functions import constants as K
from deepledger.operators import association as X

COLS = "survey_id long, image_id long, frame_index long, detection_id string, class_name string, lat double, lon double, x double, y double, w double, h double, target_id string"


def survey(seed, n=60, surveys=(1, 2)):
    r = random.Random(seed)
    spot = lambda: None if r.random() < 0.2 else r.random() / 1500
    out = []
    for i in range(n):
        lat = spot()
        frame = i // 3
        out.append((r.choice(surveys), frame, None if r.random() < 0.1 else frame, f"d{i:03d}", r.choice("aab"), lat and 50 + lat, lat and 8 + (spot() or 0.0), float(r.choice([0, 10, 30])), 3.0, 20.0, 20.0, None))
    return out


def plain_fold(rows, targets=(), boxes=True):
    """Decisions by plain loops: rows of COLS; targets: dicts of a survey that was run before."""
    decay = lambda v, full, none: max(0.0, min(1.0, (none - v) / (none - full)))
    live = [dict(t) for t in targets]
    out = {}
    for s, image, frame, det, name, lat, lon, x, y, w, h, link in sorted(rows, key=lambda d: (10**9 if d[2] is None else d[2], d[1], d[3])):
        if link:
            out[det] = (link, "reused", None)
            continue
        ranked = []
        for t in sorted(live, key=lambda t: t["id"]):
            parts, factor = [(K.ASSOCIATION_WEIGHTS["class"], float(t["class"] == name))], 1.0 if t["class"] == name else 0.35
            gap = None if frame is None or t["last"] is None else abs(frame - t["last"])
            if lat is not None and t["lat"] is not None:
                p, q = math.radians(lat), math.radians(t["lat"])
                a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(t["lon"] - lon) / 2) ** 2
                metres = 2 * 6371008.8 * math.asin(math.sqrt(a))
                parts.append((0.30, decay(metres, 8.0, 40.0)))
                factor *= 0.35 if round(metres, 1) > 40 else 1.0
            if gap is not None:
                parts.append((0.15, decay(gap, 1.0, 8.0)))
            if boxes and t["box"]:
                bx, by, bw, bh = t["box"][1]
                inner = max(0, min(x + w, bx + bw) - max(x, bx)) * max(0, min(y + h, by + bh) - max(y, by))
                iou = inner / (w * h + bw * bh - inner)
                parts.append((0.20, decay(1 - iou, 0.45, 0.95)))
                factor *= 0.5 if round(iou, 3) <= 0 and gap is not None and gap <= 1 else 1.0
            ranked.append((-round(factor * sum(a * b for a, b in parts) / sum(a for a, _ in parts), 4), t["id"], t))
        ranked.sort(key=lambda e: e[:2])
        best = -ranked[0][0] if ranked else None
        if ranked and best >= 0.62 and len(ranked) > 1 and round(best + ranked[1][0], 4) < 0.06:
            out[det] = (None, "ambiguous", best)
        elif ranked and best >= 0.62:
            t = ranked[0][2]
            if lat is not None:
                t["lat"], t["lon"] = lat, lon
            t["box"] = min(t["box"] or (det, (x, y, w, h)), (det, (x, y, w, h)))
            t["last"] = frame if t["last"] is None else t["last"] if frame is None else max(frame, t["last"])
            out[det] = (t["id"], "accepted", best)
        else:
            live.append({"id": X.new_id(s, det), "class": name, "lat": lat, "lon": lon, "box": (det, (x, y, w, h)), "last": frame})
            out[det] = (live[-1]["id"], "new_target", best)
    return out


def decided(df):
    return {r["detection_id"]: (r["target_id"], r["decision"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_against_plain_loops(spark, seed):
    rows = survey(seed)
    want = {k: v for s in (1, 2) for k, v in plain_fold([x for x in rows if x[0] == s]).items()}
    random.Random(seed).shuffle(rows)
    got = decided(X.associate(spark.createDataFrame(rows, COLS)))
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and {v[1] for v in got.values()} >= {"accepted", "new_target"}
    assert all((got[k][2] is None) == (want[k][2] is None) and (got[k][2] is None or got[k][2] == pytest.approx(want[k][2], abs=2e-4)) for k in got)


def test_second_run_reuses_links_and_takes_new_detections(spark):
    rows = survey(5, 40, (1,))
    first = X.associate(spark.createDataFrame(rows, COLS))
    links = {k: v[0] for k, v in decided(first).items()}
    place = {}
    for d in sorted(rows, key=lambda d: d[3]):
        if links[d[3]]:
            t = place.setdefault(links[d[3]], {"id": links[d[3]], "class": None, "lat": 50.0003, "lon": 8.0003, "box": (d[3], d[7:11]), "last": None})
            t["class"] = d[4]
            t["last"] = max((v for v in (t["last"], d[2]) if v is not None), default=None)
    more = [(*d[:11], links[d[3]]) for d in rows] + [(*d[:3], "n" + d[3], *d[4:]) for d in survey(6, 30, (1,))]
    targets = spark.createDataFrame([(1, t["id"], t["class"], t["lat"], t["lon"]) for t in place.values()], "survey_id long, target_id string, class_name string, lat double, lon double")
    got, want = decided(X.associate(spark.createDataFrame(more, COLS), targets)), plain_fold(more, place.values())
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(got[k][1] == "reused" for k, v in links.items() if v)


def test_boxes_count_only_between_frames_of_one_size(spark):
    rows = survey(7, 40, (1,))
    frames = spark.createDataFrame([(1, 512, 512), (1, 256, 512), (2, 64, 64)], "survey_id long, width int, height int")
    df = spark.createDataFrame(rows, COLS)
    got, want = decided(X.associate(df, frames=frames)), plain_fold(rows, boxes=False)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert X.associate(df, frames=frames).where(F.col("spatial_score").isNotNull()).count() == 0
    assert decided(X.associate(df, frames=frames.where("height = 512 and width = 512"))) == decided(X.associate(df))


def test_summary_counts(spark):
    got = X.summary(X.associate(spark.createDataFrame(survey(1), COLS))).collect()
    assert all(r["detections"] == r["accepted"] + r["ambiguous"] + r["founded"] + r["reused"] and r["reused"] == 0 for r in got)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_surveys_side_by_side_decide_as_one_by_one(seed):
    rows = pd.DataFrame(survey(seed, 400, surveys=(1, 2, 3, 5, 8, None)), columns=[c.split()[0] for c in COLS.split(", ")])
    rows = rows.assign(_survey=[None if pd.isna(s) else str(int(s)) for s in rows["survey_id"]], _kind=1, _o=rows["frame_index"].fillna(1e9))
    rows.loc[rows.index % 29 == 3, "target_id"] = "t"
    rows.loc[rows.index % 31 == 4, ["target_id", "_kind", "_o"]] = ["known", 0, -1.0]
    rows.loc[rows["_kind"] == 0, "target_id"] = "known_" + rows["detection_id"]
    rows = rows.sort_values(["_survey", "_kind", "_o", "image_id", "detection_id"]).reset_index(drop=True)
    want = [r for _, part in rows.groupby("_survey", dropna=False) for r in X.one_by_one(X.Fold(), part)]
    got = X.side_by_side(rows)
    key = lambda r: (str(r[0]), r[1])
    assert str(sorted(got, key=key)) == str(sorted(want, key=key)) and {r[3] for r in got} == {"accepted", "ambiguous", "new_target", "reused"}


def test_long_surveys_stream_beside_short_ones(spark):
    rows = [(s, i, i, f"d{s:05d}_{i:05d}", "ab"[i % 2], 50.0, 8.0, 0.0, 0.0, 5.0, 5.0, None) for s, n in [(1, 5_300), *[(s, 20) for s in range(2, 400)], (400, 5_100)] for i in range(n)]
    n = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = {tuple(r) for r in X.summary(X.associate(spark.createDataFrame(rows, COLS).coalesce(1))).select("survey_id", "detections", "targets", "ambiguous").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    assert got == {(s, k, 2, 0) for s, k in [(1, 5_300), *[(s, 20) for s in range(2, 400)], (400, 5_100)]}
