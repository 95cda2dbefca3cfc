import numpy as np
import pytest
from pyspark.sql import functions as F

from deepledger.functions import geo, text
from deepledger.operators import detections as D
from deepledger.operators import images
from deepledger.sources import files, sinks


def test_detector_finds_a_blob_and_nothing_in_noise():
    image = np.random.default_rng(11).integers(0, 41, (96, 128)).astype(float)
    assert images.detect(image) == []
    image[30:50, 50:78] = 230
    (x, y, w, h, score), = images.detect(image)
    assert abs(x + w / 2 - 64) < 3 and abs(y + h / 2 - 40) < 3 and 0.35 < score <= 0.68
    image[:] = 20
    image[40:43, :] = 250  # a thin band
    assert images.detect(image) == []


def test_morphology_against_loops():
    mask = np.random.default_rng(3).random((12, 15)) < 0.3
    for side in (3, 7):
        r = side // 2
        want = np.array([[mask[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].any() for x in range(15)] for y in range(12)])
        every = np.array([[mask[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].all() for x in range(15)] for y in range(12)])
        assert (images._widest(mask, side) == want).all() and (images._narrowest(mask, side) == every).all()
    assert images.hull_area([(0, 0, 5), (1, 0, 1), (4, 0, 5)]) == 16.0


def test_sparse_bright_needs_200_pixels(spark):
    rows = [(i, y, x, 255 if (y * 20 + x) % 20 == 0 else 50) for i, n in ((1, 10), (2, 9)) for y in range(n) for x in range(20)]
    got = {r["image_id"]: r["bright_share"] for r in images.robust_bright(spark.createDataFrame(rows, "image_id long, row int, col int, v int")).collect()}
    assert got == {1: 0.05, 2: 0.0}


def test_quality_of_a_full_image(spark):
    v = lambda y, x: (y * 37 + x * 11) % 256
    image = np.array([[v(y, x) for x in range(20)] for y in range(15)])
    pixels = spark.createDataFrame([(1, y, x, int(image[y, x])) for y in range(15) for x in range(20)], "image_id long, row int, col int, v int")
    meta = spark.createDataFrame([(1, 17.0, 78.0, 90.0, None, 30.0, "unknown")], "image_id long, lat double, lon double, heading_deg double, altitude_m double, range_m double, side string")
    got = images.quality(pixels, meta).first()
    lo, hi = np.percentile(image, (2, 98))
    noise = np.abs(np.diff(image, axis=1)).mean() + 1e-6
    assert got["contrast"] == round((hi - lo) / 256, 4) and got["noise"] == pytest.approx(noise, abs=1e-3) and got["dark"] == pytest.approx((image < 24).mean(), abs=1e-4)
    assert got["score"] == pytest.approx(20 + 30 * min(1, (hi - lo) / 256 / 0.35) + 20 * max(0, 1 - noise / 60) + 30 * 3 / 5, abs=0.05)
    assert images.quality(pixels, meta.limit(0)).first()["score"] == pytest.approx(got["score"] - 18, abs=0.11)


def test_aliases_of_every_field(spark, tmp_path):
    assert files.aliased(["Lat_Deg", "y", "Lon_deg", "gps_time", "Depth", "true_heading", "hdop", "heave_m", "receiver", "fish_x", "offset_y", "towfish_z"]) == {
        "ts": "gps_time", "latitude": "Lat_Deg", "longitude": "Lon_deg", "heading_deg": "true_heading", "altitude_m": "Depth", "accuracy_m": "hdop", "source": "receiver", "heave": "heave_m",
        "towfish_x": "fish_x", "towfish_y": "offset_y", "towfish_z": "towfish_z",
    }
    assert files.aliased(["latitude", "lat"])["latitude"] == "lat"
    (tmp_path / "n.csv").write_text("iso_time,lat,lon,depth,source,offset_x\n2026-01-01T10:00:00Z,17.44,78.38,3.5, usbl ,1.5\n")
    row = files.read_navigation(spark, str(tmp_path / "n.csv")).first()
    assert (row["altitude_m"], row["source"], row["towfish_x"], row["towfish_y"]) == (3.5, "usbl", 1.5, None)


def test_location_status_and_towfish(spark):
    names = ["approximate", "Known", "UNKNOWN", "manual", "vessel_only", "else", None]
    got = spark.createDataFrame([(x,) for x in names], "s string").select(text.location_status(F.col("s")).alias("s")).collect()
    assert [r["s"] for r in got] == ["DERIVED", "VERIFIED", "UNAVAILABLE", "MANUAL", "VESSEL_ONLY", "UNAVAILABLE", "UNAVAILABLE"]
    rows = spark.createDataFrame([(90.0, 100.0, None), (0.0, None, 100.0), (None, 5.0, 5.0), (10.0, None, None), (0.0, 0.0, None)], "b double, f double, s double")
    at = [r["t"] for r in rows.select(geo.towfish(F.lit(0.0), F.lit(10.0), F.col("b"), F.col("f"), F.col("s")).alias("t")).collect()]
    assert at[0]["lon"] == pytest.approx(10 + 100 / 111195, abs=1e-6) and at[1]["lon"] == pytest.approx(at[0]["lon"]) and at[2] is None and at[3] is None and at[4]["lon"] == 10.0


def test_ellipse_features(spark):
    cols = "survey_id long, detection_id string, lat double, lon double, semi_major_m double, semi_minor_m double, rotation_deg double"
    got = D.ellipse_features(spark.createDataFrame([(1, "a", 50.0, 8.0, 10.0, 5.0, 30.0), (1, "b", None, 8.0, 1.0, 1.0, 0.0)], cols)).collect()
    assert len(got) == 1 and '"type":"Polygon"' in got[0]["feature"] and '"kind":"uncertainty_ellipse"' in got[0]["feature"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "0 1", None), (2, "val", "1 2\n3 4", '{"a":1}')], "image_id long, split string, lines string, doc string")
    sinks.write_csv(rows.drop("lines"), str(tmp_path / "csv"), by="split")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).where("split = 'val'").select("image_id", "doc").first()[0] == "2"
    sinks.write_documents(rows, str(tmp_path / "doc"), "doc")
    assert [r[0] for r in spark.read.text(str(tmp_path / "doc")).collect()] == ['{"a":1}']
    sinks.write_label_files(rows, str(tmp_path / "labels"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "labels/image_id=2")).collect()] == ["1 2", "3 4"]
    sinks.write_manifests(rows, str(tmp_path / "split"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "split/split=train")).collect()] == ["1"]
