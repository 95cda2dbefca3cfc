import math

import pytest
from pyspark.sql import functions as F

from deepledger.functions import geo, scores, text
from deepledger.operators import evaluation, images, location


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def geodesic(spark, *where):
    return geo.geodesic(spark.range(1), "v", *where).first()["v"]


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


@pytest.mark.parametrize("bearing, lat, lon", [(0, 1, 0), (90, 0, 1), (270, 0, -1)])
def test_destinations(spark, bearing, lat, lon):
    arc = math.pi / 180 * 6371008.8
    for end in (value(spark, geo.sphere_destination(*lit(0, 0, bearing, arc))), geodesic(spark, *lit(0, 0, bearing, arc))):
        assert end["lat"] == pytest.approx(lat, abs=1e-2) and end["lon"] == pytest.approx(lon, abs=1e-2)


def test_geodesic_of_no_length_and_unknown(spark):
    assert tuple(geodesic(spark, *lit(1, 2, 3, 0))) == (1.0, 2.0)
    assert geodesic(spark, F.lit(None).cast("double"), *lit(2, 3, 5)) is None


def test_geodesic_of_a_published_line(spark):
    degrees = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    end = geodesic(spark, *lit(degrees(-37, 57, 3.7203), degrees(144, 25, 29.5244), degrees(306, 52, 5.37), 54972.271))
    assert end["lat"] == pytest.approx(degrees(-37, 39, 10.1561), abs=1e-8) and end["lon"] == pytest.approx(degrees(143, 55, 35.3839), abs=1e-8)


def test_ranges_and_headings(spark):
    assert value(spark, geo.ground_range(*lit(5, 3))) == 4.0
    assert value(spark, geo.ground_range(*lit(100, 10))) == pytest.approx(99.499, abs=1e-3)
    for h, want in ((450, 90), (-90, 270), (359.9, 359.9)):
        assert value(spark, geo.heading(F.lit(float(h)))) == pytest.approx(want)
    assert value(spark, geo.heading(F.lit(float("nan")))) is None


def test_grazing(spark):
    assert value(spark, scores.grazing_angle(*lit(20, 100))) == 11.5
    assert [value(spark, scores.grazing_score(F.lit(float(a)))) for a in (30, 8, 65, 0, 200)] == [1, 1, 1, 0, 0]


def test_fusion_renormalises(spark):
    none = F.lit(None).cast("double")
    signals = dict.fromkeys(("detection", "segmentation", "natural", "shadow", "physics", "consistency"), none)
    assert value(spark, scores.fuse(signals)) == 0.0
    some = signals | {"detection": F.lit(1.0), "shadow": F.lit(1.0)}
    assert value(spark, scores.fuse(some, gain=1.0, intercept=0.0)) == 0.7311
    three = signals | {"detection": F.lit(0.7), "segmentation": F.lit(1.0), "natural": F.lit(0.8)}
    assert value(spark, scores.fuse(three)) == 0.7824
    assert [value(spark, v) for v in list(scores.fusion_parts(three).values())[:3]] == [0.3231, 0.2308, 0.2462]


def test_status_override(spark):
    assert value(spark, scores.status(*lit(0.9, 0.95, 0.2))) == "human_review_required"
    assert value(spark, scores.status(*lit(0.9, 0.1, 0.2))) == "confirmed"


def test_priority_of_each_class(spark):
    base = {"wreck": 47.25, "debris": 37.75, "unknown_anomaly": 37.5, "other": 35.0, "tire": 33.5, "structure": 30.25}
    for name, points in base.items():
        assert value(spark, scores.priority(F.lit(name), F.lit(0.0), F.lit(0.0))) == pytest.approx(math.floor(points * 10 + 0.5) / 10)


def test_association_signals(spark):
    assert value(spark, scores.ramp(F.lit(5.5), 8, 40)) == 1.0
    assert value(spark, scores.ramp(F.lit(55.0), 8, 40)) == 0.0
    assert value(spark, scores.association(F.lit(False), *lit(0, 1, 1))) == 0.2275
    assert value(spark, scores.association(F.lit(True), F.lit(None).cast("double"), *lit(1, 0))) == 0.3571


def test_utm(spark):
    p = value(spark, geo.utm_inverse(*lit(443000, 1928000, 44), F.lit(False)))
    assert p["lat"] == pytest.approx(17.4366, abs=1e-3) and p["lon"] == pytest.approx(80.4634, abs=1e-3)


def test_ring_is_closed(spark):
    ring = value(spark, geo.ring(*lit(54, 10, 20, 10, 30)))
    assert len(ring) == 37 and ring[0] == ring[-1]


@pytest.mark.parametrize(
    "shown, want",
    [("2026-01-01T10:00:00Z", 1767261600), ("2026-01-01 10:00:00", 1767261600), ("2026-01-01T12:00:00+02:00", 1767261600), ("2026:01:01 10:00:00", 1767261600), ("20260101", 1767225600), ("2026-01-01", 1767225600), ("1767261600", None), ("soon", None), ("2026-13-01", None)],
)
def test_timestamps(spark, shown, want):
    assert value(spark, F.unix_seconds(text.timestamp(F.lit(shown)))) == want


@pytest.mark.parametrize("shown, want", [("54 30.000 N", 54.5), ("1045.500W", -10.758333), ("12.25 S", -12.25), ("-3.5", -3.5), ("north", None), ("200.5 E", None)])
def test_coordinates(spark, shown, want):
    got = value(spark, text.coordinate(F.lit(shown)))
    assert got is None if want is None else got == pytest.approx(want, abs=1e-5)


def test_safe_names(spark):
    for name, want in (("../a b.png", "a_b.png"), ("c:\\x\\y.tif", "y.tif"), ("..", "file")):
        assert value(spark, text.safe_name(F.lit(name))) == want


def test_location_fusion_and_consistency(spark):
    rows = spark.createDataFrame([("t", "a", 15.0001, 73.0001, 10.0), ("t", "b", 15.0002, 73.0002, 5.0), ("u", "c", 15.0, 73.0, 5.0), ("u", "d", 15.01, 73.0, 5.0), ("v", "e", None, None, None)], "target_id string, detection_id string, lat double, lon double, uncertainty_m double")
    t = {r["target_id"]: r for r in location.fused_locations(rows).collect()}
    assert t["t"]["lat"] == pytest.approx(15.00018) and t["t"]["uncertainty_m"] == 4.47 and "v" not in t
    c = {r["target_id"]: r for r in location.location_consistency(rows).collect()}
    assert c["t"]["status"] == "consistent" and c["u"]["status"] == "inconsistent" and "v" not in c


def test_uncertainty_matches_sample_covariance(spark):
    import numpy as np

    rows = spark.createDataFrame([(1, 50.0, 10.0, 90.0, "port", None), (2, 30.0, 5.0, 0.0, "starboard", 2.5)], "id long, slant_m double, effective_m double, ok_heading double, ok_side string, accuracy_m double")
    got = {r["id"]: r for r in location.uncertainty(rows, "id").collect()}
    rng = np.random.default_rng(0)
    h, g = 90 + rng.normal(0, 2, 300), rng.normal(0, 5, (300, 2))
    s, a = 50 * (1 + rng.normal(0, 0.05, 300)), 10 * (1 + rng.normal(0, 0.05, 300))
    ground, b = np.sqrt(s**2 - a**2), np.radians(h - 90)
    values = np.linalg.eigvalsh(np.cov(np.stack([ground * np.sin(b) + g[:, 0], ground * np.cos(b) + g[:, 1]])))
    assert got[1]["semi_major_m"] == pytest.approx(2 * values[1] ** 0.5, abs=0.06) and got[1]["semi_minor_m"] == pytest.approx(2 * values[0] ** 0.5, abs=0.06)


def test_matching_and_suppression(spark):
    d = spark.createDataFrame([(1, "a", 0.0, 0.0, 10.0, 10.0, 0.9), (1, "b", 1.0, 0.0, 10.0, 10.0, 0.8), (1, "c", 50.0, 50.0, 5.0, 5.0, 0.7), (2, "d", 0.0, 0.0, 5.0, 5.0, 0.5)], "image_id long, detection_id string, x double, y double, w double, h double, score double")
    t = spark.createDataFrame([(1, "t", 0.0, 0.0, 10.0, 10.0), (3, "u", 0.0, 0.0, 9.0, 9.0)], "image_id long, truth_id string, x double, y double, w double, h double")
    got = {r["image_id"]: (r["tp"], r["fp"], r["fn"]) for r in evaluation.greedy_match(d, t).collect()}
    assert got == {1: (1, 2, 0), 2: (0, 1, 0), 3: (0, 0, 1)}
    p = evaluation.precision_recall(evaluation.greedy_match(d, t)).first()
    assert (p["precision"], p["recall"], p["f1"]) == (0.25, 0.5, 0.3333)
    assert sorted(r["detection_id"] for r in evaluation.suppress(d).collect()) == ["a", "c", "d"]


def test_split_of_few_sites_goes_by_image(spark):
    rows = spark.createDataFrame([(i, "s", i % 2) for i in range(50)], "image_id long, site string, label int")
    assert {r["split"] for r in evaluation.site_split(rows).collect()} == {"train", "val"}


def test_image_kernels(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    scene = rng.integers(0, 40, (96, 128)).astype(np.uint8)
    scene[30:50, 50:78] = 230
    frame = spark.createDataFrame([(1, bytearray(scene.tobytes()), 96, 128), (2, bytearray(bytes(96 * 128)), 96, 128)], "image_id long, data binary, height int, width int")
    found = images.detect_images(frame).collect()
    assert found and all(r["image_id"] == 1 for r in found) and any(r["x"] < 64 < r["x"] + r["w"] + 20 for r in found)
    anomaly = images.patch_anomaly(frame, least=20).where("image_id = 1").collect()
    hot = max(anomaly, key=lambda r: r["score"])
    assert len(anomaly) == 48 and 16 <= hot["row"] <= 48 and 32 <= hot["col"] <= 80
    assert [images.bounds(r) for r in images.regions(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool))] == [(0, 0, 2, 2, 2), (0, 3, 2, 1, 2)]


def test_detections_are_derived_after_their_join(spark):
    """So that the shuffle carries the table's columns, not the wider ones made of them."""
    from deepledger.sources import adapters

    plan = adapters.detections(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("concat_ws") < plan.index("Join") and plan.count("concat_ws") == 1
