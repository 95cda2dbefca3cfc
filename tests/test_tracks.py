import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from deepledger.operators import association as X
from deepledger.operators import detections as D
from deepledger.operators import navigation as N
from deepledger.sources import files
from deepledger.streaming import jobs

T0 = dt.datetime(2026, 1, 1, 10, 0, 0)
FIX = "survey_id long, fix_id long, ts timestamp, lat double, lon double, heading_deg double, altitude_m double, accuracy_m double"


def track(spark, rows):
    return spark.createDataFrame([(1, i, T0 + dt.timedelta(seconds=s), lat, lon, h, 3.0, 2.0) for i, (s, lat, lon, h) in enumerate(rows)], FIX)


def test_sync_methods(spark):
    t = track(spark, [(0, 17.44, 78.38, 350.0), (10, 17.44009, 78.38, 10.0), (20, 17.44018, 78.38, 10.0)])
    frames = spark.createDataFrame([(1, 1, T0 + dt.timedelta(seconds=15)), (1, 2, T0 + dt.timedelta(seconds=9.5)), (1, 3, T0 - dt.timedelta(hours=1)), (1, 4, T0 + dt.timedelta(seconds=5)), (2, 5, T0)], "survey_id long, frame_id long, ts timestamp")
    got = {r["frame_id"]: r for r in N.synchronised(frames, t).collect()}
    assert [got[i]["method"] for i in range(1, 6)] == ["interpolated", "exact_timestamp", "nearest", "interpolated", "none"]
    assert got[1]["lat"] == pytest.approx(17.440135, abs=1e-7) and got[2]["lat"] == 17.44009 and got[3]["lat"] == 17.44 and got[5]["lat"] is None
    assert got[4]["heading_deg"] == 0.0


def test_diagnostics(spark):
    t = track(spark, [(0, 17.44, 78.38, 0.0), (0, 17.44, 78.38, 0.0), (10, 17.54, 78.38, 0.0), (400, 17.54, 78.38, 0.0), (410, 95.0, 78.0, 0.0), (420, None, 78.0, 0.0)])
    got = {r["fix_id"]: r["invalid"] for r in N.diagnosed(t).collect()}
    assert got == {0: None, 1: "duplicate timestamp", 2: "impossible jump", 3: None}
    s = N.track_stats(t).first()
    assert (s["total"], s["rejected"], s["duplicates"], s["jump_ends"], s["gaps"]) == (6, 2, 1, 1, 1)


def seeds(*rows):
    return [(1, 100 + f, f, f"d{i}", c, lat, lon, 50.0, 60.0, 20.0, 16.0) for i, (f, c, lat, lon) in enumerate(rows)]


SCHEMA = "survey_id long, image_id long, frame_index long, detection_id string, class_name string, lat double, lon double, x double, y double, w double, h double"
METRE = 1 / 111194.9


@pytest.mark.parametrize(
    "rows, want",
    [
        (seeds((0, "tire", 54.0, 10.0), (1, "tire", 54.0, 10.0)), ["new_target", "accepted"]),
        (seeds((0, "tire", 54.0, 10.0), (1, "wreck", 54.0, 10.0)), ["new_target", "new_target"]),
        (seeds((0, "tire", 54.0, 10.0), (1, "tire", 54.0 + 900 * METRE, 10.0)), ["new_target", "new_target"]),
    ],
)
def test_fold_decisions(spark, rows, want):
    got = {r["detection_id"]: r["decision"] for r in X.associate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in sorted(got)] == want


def test_fold_is_independent_of_input_order_and_stream_equals_batch(spark, tmp_path):
    rows = [(s, 100 * s + f, f, f"d{s}_{f}_{k}", "tire" if k else "wreck", 54 + f * 3 * METRE, 10.0 + k * 30 * METRE, 50.0, 60.0, 20.0, 16.0) for s in (1, 2) for f in range(6) for k in range(3)]
    key = lambda df: sorted((r["survey_id"], r["detection_id"], r["target_id"] or "", r["decision"]) for r in df.collect())
    want = key(X.associate(spark.createDataFrame(rows, SCHEMA)))
    assert want == key(X.associate(spark.createDataFrame(rows[::-1], SCHEMA)))
    for part in (0, 1):
        pd.DataFrame([r for r in rows if (r[2] >= 3) == bool(part)], columns=[c.split()[0] for c in SCHEMA.split(", ")]).to_parquet(tmp_path / f"{part}.parquet")
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    for part in (0, 1):
        (tmp_path / f"{part}.parquet").rename(tmp_path / "in" / f"{part}.parquet")
        stream = X.associate_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert want == key(spark.read.parquet(out))


def test_sessions_stream(spark, tmp_path):
    fixes = track(spark, [(0, 17.0, 78.0, 0.0), (30, 17.0, 78.0, 0.0), (300, 17.0, 78.0, 0.0), (9000, 17.0, 78.0, 0.0)])
    fixes.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = jobs.session_stream(spark.readStream.schema(FIX).parquet(str(tmp_path / "in")))
    events = list(jobs.run_job(stream, lambda b, n: seen.extend(b.collect()), str(tmp_path / "c"), "sessions").follow())
    assert sorted(r["fixes"] for r in seen) == [1, 2] and [e["status"] for e in events][:2] == ["queued", "running"] and events[-1]["status"] == "done"


def test_navigation_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Time,LAT,Lng,Heading,crs\n2026-01-01T10:00:00Z,17.44,78.38,90,\nbad,443000,1928000,,\n2026-01-01T10:00:00Z,1928000,443000,x,EPSG:32644\n")
    rows = files.read_navigation(spark, str(tmp_path / "a.csv")).collect()
    assert rows[0]["latitude"] == 17.44 and rows[0]["heading_deg"] == 90 and rows[1]["ts"] is None
    assert 17 < rows[2]["latitude"] < 18 and 80 < rows[2]["longitude"] < 81 and rows[2]["heading_deg"] is None
    (tmp_path / "b.csv").write_text("time,speed\n1,2\n")
    assert files.read_navigation(spark, str(tmp_path / "b.csv")).count() == 0
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[78.38,17.44]},"properties":{"Heading":"90","time":1767261600}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[1,2]},"properties":{}}]}')
    g = files.read_navigation(spark, str(tmp_path / "c.geojson")).collect()
    assert len(g) == 1 and g[0]["latitude"] == 17.44 and g[0]["heading_deg"] == 90 and g[0]["ts"] is not None
    (tmp_path / "d.gpx").write_text('<gpx><trk><trkseg><trkpt lat="17.44" lon="78.38"><ele>3.0</ele><time>2026-01-01T10:00:00Z</time></trkpt></trkseg></trk><wpt lat="1" lon="2"></wpt></gpx>')
    x = sorted(files.read_navigation(spark, str(tmp_path / "d.gpx")).collect(), key=lambda r: r["latitude"])
    assert [r["latitude"] for r in x] == [1.0, 17.44] and x[1]["altitude_m"] == 3.0 and x[0]["ts"] is None
    with pytest.raises(ValueError):
        files.read_navigation(spark, "x.pdf")


def test_label_files(spark, tmp_path):
    (tmp_path / "im_1.txt").write_text("0 0.5 0.5 0.1 0.1\n\n9 0.5 0.5 0.1\n")
    lines = files.read_label_lines(spark, str(tmp_path / "im_1.txt"))
    assert lines.count() == 2 and lines.first()["image"] == "im_1"
    (tmp_path / "v.xml").write_text("<annotation><object><name> ship </name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>11</xmax><ymax>22</ymax></bndbox></object></annotation>")
    assert tuple(files.read_voc_boxes(spark, str(tmp_path / "v.xml")).first()) == ("ship", 1.0, 2.0, 10.0, 20.0)
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text('{"id":"a","name":"A","images":["x","y"],"ground_truth":[{"image":"x","boxes":[{"x":1,"y":1,"w":2,"h":2,"class":"tire"}]}]}')
    (tmp_path / "m/b.json").write_text("{broken")
    assert [tuple(r) for r in files.read_manifests(spark, str(tmp_path / "m")).collect()] == [("a", "A", 2, 1, True)]


def test_upsert_keeps_links(spark):
    old = spark.createDataFrame([("a", "t1", 0.1), ("b", None, 0.2)], "detection_id string, target_id string, confidence double")
    new = spark.createDataFrame([("a", None, 0.9), ("c", "t2", None)], old.schema)
    got = {r["detection_id"]: (r["target_id"], r["confidence"]) for r in D.upsert(old, new, "detection_id", ("target_id",)).collect()}
    assert got == {"a": ("t1", 0.9), "b": (None, 0.2), "c": ("t2", None)}
    replaced = D.replace_group(old, old.limit(0), "detection_id", old.where("detection_id = 'a'"))
    assert [r["detection_id"] for r in replaced.collect()] == ["b"]


def test_geojson_without_position(spark):
    rows = spark.createDataFrame([(1, "a", "tire", None, None), (1, "b", "tire", 0.0, 10.0)], "survey_id long, detection_id string, class_name string, lat double, lon double")
    got = {r["detection_id"]: r["feature"] for r in D.geojson_features(rows).collect()}
    assert '"geometry":null' in got["a"] and '"coordinates":[10.0,0.0]' in got["b"]
    assert rows.select(F.count("*")).first()[0] == 2


def test_fold_streams_a_survey_in_batches(spark):
    import random

    cols = "survey_id long, image_id long, frame_index long, detection_id string, class_name string, lat double, lon double, x double, y double, w double, h double"
    r = random.Random(4)
    rows = [(r.choice([1, 2, None]), r.choice([i // 3, None]), r.choice([i // 3, i // 3, None]), f"d{i:03d}", r.choice("ab"), 50 + r.random() / 900, 8.0, float(r.randrange(40)), 3.0, 20.0, 20.0) for i in range(150)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, cols)
    whole = df.groupBy("survey_id").applyInPandas(lambda x: X.Fold().run(x), X.DECISION)
    key = lambda x: [str(v) for v in x]
    want = sorted(map(tuple, whole.collect()), key=key)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = X.associate(df)
        assert sorted(map(tuple, got.collect()), key=key) == want
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_projection_of_a_named_column(spark, tmp_path):
    from deepledger.sources import files

    (tmp_path / "geo.csv").write_text("lat,lon,geometry.crs,epsg\n1928000,443000,EPSG:32644,4326\n")
    row = files.read_csv(spark, str(tmp_path / "geo.csv")).first()
    assert (round(row["latitude"], 1), round(row["longitude"], 1)) == (17.4, 80.5)
    assert files.aliased(["lat", "crs", "a.crs"])["crs"] == "crs" and "crs" not in files.aliased(["lat", "epsg", "acrs"])
