import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from deepledger.operators import pictures as P
from deepledger.sources import pictures as S

IMAGES = "image_id long, data binary, height int, width int"
BOXES = "image_id long, detection_id string, x double, y double, w double, h double"


def table_of(spark, *images):
    return spark.createDataFrame([(i, x.astype(np.uint8).tobytes(), *x.shape) for i, x in enumerate(images)], IMAGES)


def pixels_of(spark, *images):
    rows = [(i, y, x, int(v)) for i, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "image_id long, row int, col int, v int")


def array_of(rows, shape):
    out = np.full(shape, -1)
    for r in rows:
        out[r["row"], r["col"]] = r["v"]
    return out


def test_columns_and_kernels_agree(spark):
    noise = np.random.default_rng(5).integers(0, 256, (40, 30))
    flat = np.full((6, 4), 7)
    meta = spark.createDataFrame([(0, 50.0, 9.0), (1, None, 3.0)], "image_id long, range_m double, altitude_m double")
    steps = P.stretched(pixels_of(spark, noise, flat))
    shown = P.ground_spaced(P.gained(steps, meta), meta).collect()
    wanted = P.prepare(noise.astype(float), "light", 50.0, 9.0, False)[0]
    assert (array_of(P.stretched(pixels_of(spark, noise)).collect(), noise.shape) == wanted).all()
    saved = P.PRESETS["light"]
    try:
        P.PRESETS["light"] = {**saved, "tvg": True}
        wanted, names = P.prepare(noise.astype(float), "light", 50.0, 9.0, True)
    finally:
        P.PRESETS["light"] = saved
    assert (array_of([r for r in shown if r["image_id"] == 0], noise.shape) == wanted).all() and len(names) == 3
    assert (array_of([r for r in shown if r["image_id"] == 1], flat.shape) == 0).all()


def test_ground_spacing_takes_the_near_rows_for_the_water_column(spark):
    image = np.repeat(np.arange(20)[:, None], 2, axis=1)
    meta = spark.createDataFrame([(0, 40.0, 10.0), (1, 40.0, 40.0)], "image_id long, range_m double, altitude_m double")
    rows = P.ground_spaced(pixels_of(spark, image, image), meta).collect()
    first, second = [array_of([r for r in rows if r["image_id"] == i], image.shape)[:, 0] for i in (0, 1)]
    assert first[0] >= 4 and first[-1] == 19 and (np.diff(first) >= 0).all()
    assert (second == np.arange(20)).all()  # an altitude of the range or more


def test_presets_record_their_steps(spark):
    image = np.random.default_rng(1).integers(30, 90, (48, 40))
    meta = spark.createDataFrame([(0, 50.0, 5.0)], "image_id long, range_m double, altitude_m double")
    got = {p: P.prepared(table_of(spark, image), meta, p, display=True).first() for p in ("light", "standard", "aggressive", "other")}
    assert got["light"]["steps"] == got["other"]["steps"] == ["normalize(1-99 percentile stretch)", "slant_range_correct(display)"]
    assert got["standard"]["steps"][1:4] == ["despeckle:median3", "clahe(clip=2.0)", "tvg(range gain compensation)"]
    assert got["aggressive"]["steps"][1:3] == ["despeckle:fastNlMeans", "clahe(clip=3.0)"]
    assert P.prepared(table_of(spark, image).limit(0), meta).count() == 0


def test_equalisation_and_smoothing():
    ramp = np.tile(np.arange(64) + 90.0, (64, 1))
    out = P.equalised(ramp, 40.0)
    assert out.max() - out.min() > 150 and out.shape == ramp.shape and P.equalised(ramp[:13, :9], 2.0).shape == (13, 9)
    noise = 100 + np.random.default_rng(2).normal(0, 3, (40, 40))
    assert P.non_local_mean(noise).std() < noise.std() / 2
    assert (P.non_local_mean(np.full((5, 4), 9.0)) == 9).all()


def test_tiles_and_their_mean(spark):
    image = np.zeros((10, 7))
    tiles = P.on_tiles(pixels_of(spark, image), 4, 3)
    got = P.tile_mean(tiles.withColumn("p", (F.col("tile_row") + F.col("tile_col")) / 10)).collect()
    total, count = np.zeros(image.shape), np.zeros(image.shape)
    for y in range(0, 7, 3):
        for x in range(0, 4, 3):
            total[y : y + 4, x : x + 4] += (y + x) / 10
            count[y : y + 4, x : x + 4] += 1
    assert len(got) == 70 and all(r["p"] == pytest.approx(total[r["row"], r["col"]] / max(count[r["row"], r["col"]], 1), abs=1e-6) for r in got)
    small = P.on_tiles(pixels_of(spark, np.zeros((2, 9))), 8, 6).groupBy("col").agg(F.max("tile_col").alias("t")).collect()
    assert {r["col"]: r["t"] for r in small}[8] is None  # left over at the far edge


def scene():
    image = np.full((120, 120), 60.0) + np.random.default_rng(0).integers(-3, 4, (120, 120))
    image[40:60, 50:80] = 200
    return image


def test_segment_and_features(spark):
    boxes = spark.createDataFrame([(0, "a", 45.0, 35.0, 40.0, 30.0), (0, "out", 500.0, 0.0, 9.0, 9.0), (7, "none", 0.0, 0.0, 9.0, 9.0)], BOXES)
    got = {r["detection_id"]: r for r in P.segments(table_of(spark, scene()), boxes).collect()}
    assert set(got) == {"a", "out"} and got["out"]["area_fraction"] == 0 and got["out"]["solidity"] is None
    a = got["a"]
    assert a["area_fraction"] == pytest.approx(600 / 1200, abs=0.02) and a["difference"] > 120 and a["variation"] < 0.05
    assert a["solidity"] > 0.9 and a["straightness"] == 1.0


def test_artificial_scores(spark):
    row = spark.range(1)
    parts = lambda *x: P.feature_scores(*[F.lit(v) for v in x])
    got = row.select(
        P.artificial(parts(0.0, 80.0, 0.8, 0.5), F.lit(0.0)), P.artificial(parts(0.3, 0.0, 0.3, 0.0), F.lit(0.06)), P.artificial(parts(0.15, 40.0, 0.575, 0.25), F.lit(0.61)), P.softmax_artificial(F.lit(1.0), F.lit(1.0))
    ).first()
    assert tuple(got) == (0.95, pytest.approx(0.15), 0.5, 0.5)


def test_crops(spark):
    boxes = spark.createDataFrame([(0, "a", 50.0, 40.0, 30.0, 20.0), (0, "edge", 116.0, 0.0, 30.0, 30.0), (0, "half", -20.0, -20.0, 50.0, 50.0)], BOXES)
    got = {r["detection_id"]: r for r in P.crops(table_of(spark, scene()), boxes).collect()}
    assert set(got) == {"a", "half"}  # 7 columns of the other are within the image
    assert (got["a"]["height"], got["a"]["width"]) == (23, 35) and (got["half"]["height"], got["half"]["width"]) == (34, 34)
    assert got["a"]["data"] == scene()[38:61, 47:82].astype(np.uint8).tobytes()


def test_images_masks_and_previews_round_trip(spark, tmp_path):
    grey = np.random.default_rng(3).integers(0, 256, (9, 13))
    colour = np.random.default_rng(4).integers(0, 256, (5, 6, 3))
    for name, image in (("grey", grey), ("colour", colour)):
        (tmp_path / f"{name}.png").write_bytes(S.png(image))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in S.read_images(spark, str(tmp_path)).collect()}
    assert got["grey.png"]["data"] == grey.astype(np.uint8).tobytes() and (got["grey.png"]["height"], got["grey.png"]["width"]) == (9, 13)
    mixed = np.frombuffer(got["colour.png"]["data"], np.uint8).reshape(5, 6)
    assert np.abs(mixed - colour @ [0.299, 0.587, 0.114]).max() <= 0.51
    assert got.get("broken.png") is None or got["broken.png"]["data"] is None
    mask = {r["path"].rsplit("/", 1)[-1]: r["data"] for r in S.read_masks(spark, str(tmp_path)).collect()}
    assert mask["grey.png"] == (grey > 0).astype(np.uint8).tobytes() and mask["colour.png"] == (colour[:, :, 2] > 0).astype(np.uint8).tobytes()
    boxes = spark.createDataFrame([(0, "a", 2.0, 2.0, 5.0, 4.0)], BOXES)
    (tmp_path / "shown").mkdir()
    (tmp_path / "shown" / "x.png").write_bytes(S.previews(table_of(spark, grey), boxes).first()["png"])
    shown = np.frombuffer(spark.read.format("image").load(str(tmp_path / "shown")).select("image.data").first()[0], np.uint8).reshape(9, 13, 3)
    assert tuple(shown[2, 4]) == (0, 255, 0) and tuple(shown[4, 4]) == (grey[4, 4],) * 3


def exif(order, lat_ref=b"S\0", lon=(10, 30, 0)):
    gps = [(1, 2, 2, lat_ref.ljust(4, b"\0")), (2, 5, 3, None), (3, 2, 2, b"E\0\0\0"), (4, 5, 3, None), (6, 5, 1, None)]
    date = b"2024:05:06 07:08:09\0"
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    at = 8 + 2 + 24 + 4
    gps_at = at + len(date)
    values_at = gps_at + 2 + 12 * len(gps) + 4
    main = struct.pack(order + "HHHII", 2, 306, 2, len(date), at) + struct.pack(order + "HHII", 34853, 4, 1, gps_at) + bytes(4)
    values = [struct.pack(order + "6I", 54, 1, 15, 1, 36, 1), struct.pack(order + "6I", *[x for v in lon for x in (v, 1)]), struct.pack(order + "2I", 25, 2)]
    entries, place, k = struct.pack(order + "H", len(gps)), values_at, 0
    for tag, kind, n, inline in gps:
        entries += struct.pack(order + "HHI", tag, kind, n) + (inline or struct.pack(order + "I", place))
        if inline is None:
            place, k = place + len(values[k]), k + 1
    return head + main + date + entries + bytes(4) + b"".join(values)


def test_exif(spark, tmp_path):
    tiff = exif("<")
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.tif").write_bytes(exif(">", b"N\0", (200, 0, 0)))
    (tmp_path / "c.jpg").write_bytes(jpeg[:60])
    (tmp_path / "d.png").write_bytes(S.png(np.zeros((2, 2))))
    got = {r["path"].rsplit("/", 1)[-1]: tuple(r)[1:] for r in S.read_exif(spark, str(tmp_path)).collect()}
    assert got["a.jpg"] == (-54.26, 10.5, 12.5, "2024:05:06 07:08:09")
    assert got["b.tif"] == (54.26, None, 12.5, "2024:05:06 07:08:09")  # a longitude out of range
    assert got["c.jpg"][:3] == (None, None, None) and got["d.png"] == (None,) * 4


def test_crop_index(spark, tmp_path):
    (tmp_path / "i.csv").write_text("file,source,site\nx.png,a,b\n")
    assert S.read_crop_index(spark, str(tmp_path / "i.csv")).first().asDict() == {"file": "x.png", "source": "a", "site": "b"}
