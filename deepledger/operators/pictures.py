"""Preparation, tiles, crops and segments of pictures: over pixel tables (image_id, row, col, v) where columns can say it, else kernels within tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deepledger.functions.scores import clamp
from deepledger.operators.images import _narrowest, _widest, bounds, grey, hull_area, median3, regions

#: Fixed values of the presets, of the range gain, of tiles and crops.
PRESETS = {
    "light": {"despeckle": None, "clahe": False, "tvg": False},
    "standard": {"despeckle": "median3", "clahe": 2.0, "tvg": True},
    "aggressive": {"despeckle": "nlm", "clahe": 3.0, "tvg": True},
}
STEPS = {"stretch": "normalize(1-99 percentile stretch)", "median3": "despeckle:median3", "nlm": "despeckle:fastNlMeans", "clahe": "clahe(clip={})", "tvg": "tvg(range gain compensation)", "slant": "slant_range_correct(display)"}
GAIN_LOW, GAIN_HIGH = 0.5, 4.0
TILE, TILE_STEP = 512, 384
CROP_PAD, CROP_SIDE = 0.08, 8
#: Fixed values of the threshold segmenter and of the natural or artificial score.
SEGMENT_K, SEGMENT_WEAK_K, RING_PIXELS = 1.6, 0.8, 60
FEATURE_WEIGHTS = {"homogeneity": 0.38, "contrast": 0.22, "solidity": 0.24, "straightness": 0.16}
P_LOW, P_HIGH, SPARSE_LOW, SPARSE_HIGH, SPARSE_GAIN = 0.05, 0.95, 0.06, 0.60, 0.10


def _level(x: Column) -> Column:
    """A grey level cut to 0..255 and to a whole number; what is off by rounding only counts as whole."""
    return F.floor(F.round(clamp(x, 0.0, 255.0), 6)).cast("int")


def stretched(pixels: DataFrame) -> DataFrame:
    """The 1st to 99th percentile of each image taken to 0..255; an image with no span becomes 0."""
    span = pixels.groupBy("image_id").agg(F.percentile("v", 0.01).alias("lo"), F.percentile("v", 0.99).alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), _level((F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")))).otherwise(0)
    return pixels.join(span, "image_id").select("image_id", "row", "col", v.alias("v"))


def _heights(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """(image_id, height, range_m, altitude_m) of each image; null range and altitude where meta, one row an image at most, has none."""
    heights = pixels.groupBy("image_id").agg((F.max("row") + 1).cast("double").alias("height"))
    return heights.join(meta.select("image_id", F.col("range_m").cast("double"), F.col("altitude_m").cast("double")), "image_id", "left")


def _ground(slant: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), slant * slant - F.col("altitude_m") * F.col("altitude_m")))


def gained(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Each row times the square of its share of the largest ground range, the gain kept to GAIN_LOW..GAIN_HIGH.

    meta: (image_id, range_m, altitude_m). Images whose range or altitude is null or 0 stay as they are.
    """
    rows = pixels.join(_heights(pixels, meta), "image_id")
    full = F.greatest("range_m", F.lit(1.0))
    share = _ground(full * F.col("row") / F.greatest(F.col("height") - 1, F.lit(1.0))) / F.greatest(_ground(F.when(F.col("height") > 1, full).otherwise(0.0)), F.lit(1e-6))
    known = (F.col("range_m") != 0) & (F.col("altitude_m") != 0)
    v = F.when(known, _level(F.col("v") * clamp(share * share, GAIN_LOW, GAIN_HIGH))).otherwise(F.col("v").cast("int"))
    return rows.select("image_id", "row", "col", v.alias("v"))


def ground_spaced(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows resampled, by the nearest source row, so that equal steps are equal ground ranges; for display only.

    Images with an altitude of 0 or less, of the range or more, or without either stay as they are. The source row follows from the
    geometry alone, so the pixels are joined once, by image and row.
    """
    last = F.col("height") - 1
    m = _heights(pixels, meta).withColumn("fit", F.coalesce((F.col("altitude_m") > 0) & (F.col("altitude_m") < F.col("range_m")) & (F.col("height") > 1), F.lit(False)))
    m = m.select("*", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("out"))
    m = m.withColumn("at", _ground(F.col("range_m")) * F.col("out") / last)
    m = m.withColumn("below", F.least(last - 1, F.floor(F.sqrt(F.col("at") * F.col("at") + F.col("altitude_m") * F.col("altitude_m")) / F.col("range_m") * last)))
    m = m.withColumns({"g0": _ground(F.col("range_m") * F.col("below") / last), "g1": _ground(F.col("range_m") * (F.col("below") + 1) / last)})
    source = F.col("below") + F.when(F.col("g1") > F.col("g0"), (F.col("at") - F.col("g0")) / (F.col("g1") - F.col("g0"))).otherwise(1.0)
    row = F.when(F.col("fit"), clamp(F.rint(F.round(source, 6)), 0.0, last)).otherwise(F.col("out")).cast(pixels.schema["row"].dataType)
    return pixels.join(m.select("image_id", "out", row.alias("row")), ["image_id", "row"]).select("image_id", F.col("out").alias("row"), "col", "v")


def on_tiles(pixels: DataFrame, tile: int = TILE, step: int = TILE_STEP) -> DataFrame:
    """Each pixel once for every tile that covers it, with the tile's first row and column as tile_row and tile_col; null for none.

    Tiles start at multiples of step as long as they lie within the image; an image smaller than a tile has one, from 0. What the
    last tiles leave over at the far edges is covered by none.
    """
    sizes = pixels.groupBy("image_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))

    def starts(place: str, size: str) -> Column:
        every = F.sequence(F.lit(0), F.greatest(F.col(size) - tile, F.lit(0)).cast("int"), F.lit(step))
        return F.filter(every, lambda s: (s <= F.col(place)) & (F.col(place) < s + tile))

    rows = pixels.join(sizes, "image_id").select(*pixels.columns, starts("row", "height").alias("_r"), starts("col", "width").alias("_c"))
    return rows.select(*pixels.columns, F.explode_outer("_r").alias("tile_row"), "_c").select(*pixels.columns, "tile_row", F.explode_outer("_c").alias("tile_col"))


def tile_mean(scored: DataFrame) -> DataFrame:
    """(image_id, row, col, p, predicted): the mean of p over the tiles that cover a pixel, 0 without any, and whether it is above a half."""
    p = F.coalesce(F.avg(F.when(F.col("tile_row").isNotNull() & F.col("tile_col").isNotNull(), F.col("p"))), F.lit(0.0))
    return scored.groupBy("image_id", "row", "col").agg(F.round(p, 6).alias("p")).withColumn("predicted", F.col("p") > 0.5)


def crop_bounds(boxes: DataFrame, width: Column, height: Column, pad: float = CROP_PAD, side: int = CROP_SIDE) -> DataFrame:
    """boxes (x, y, w, h and others) with x0, y0, x1, y1 of the padded crop within the image; crops with a side below `side` are left out."""
    low = lambda at, size: F.greatest(F.lit(0), (F.col(at) - pad * F.col(size)).cast("int"))
    high = lambda at, size, end: F.least(end.cast("int"), (F.col(at) + F.col(size) * (1 + pad)).cast("int"))
    out = boxes.withColumns({"x0": low("x", "w"), "y0": low("y", "h"), "x1": high("x", "w", width), "y1": high("y", "h", height)})
    return out.where((F.col("x1") - F.col("x0") >= side) & (F.col("y1") - F.col("y0") >= side))


def feature_scores(variation: Column, difference: Column, solidity: Column, straightness: Column) -> dict[str, Column]:
    """The four parts of the heuristic score in 0..1: from deviation over mean, grey levels above the surroundings, solidity and straightness."""
    return {"homogeneity": clamp(1 - variation / 0.30), "contrast": clamp(difference / 80.0), "solidity": clamp((solidity - 0.35) / 0.45), "straightness": clamp(straightness / 0.5)}


def artificial(parts: dict[str, Column], sparse: Column) -> Column:
    """Probability that an object is artificial; a share of sparse bright pixels in SPARSE_LOW..SPARSE_HIGH adds SPARSE_GAIN."""
    p = F.round(F.round(clamp(sum(w * parts[k] for k, w in FEATURE_WEIGHTS.items()), P_LOW, P_HIGH), 9), 3)  # ties as they are meant
    return F.when(sparse.between(SPARSE_LOW, SPARSE_HIGH), F.least(F.lit(P_HIGH), p + SPARSE_GAIN)).otherwise(p)


def softmax_artificial(natural: Column, made: Column) -> Column:
    """The second of two logits' softmax, kept to P_LOW..P_HIGH, to 3 decimals."""
    return F.round(clamp(1 / (1 + F.exp(natural - made)), P_LOW, P_HIGH), 3)


def equalised(image: np.ndarray, clip: float, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: a clipped cumulative histogram for each of tiles x tiles, blended between tile centres."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(image.astype(np.int64), [(0, th * tiles - h), (0, tw * tiles - w)], mode="symmetric")
    blocks = full.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, th * tw)
    counts = np.stack([np.bincount(b, minlength=256) for b in blocks])
    most = max(int(clip * th * tw / 256), 1)
    over = np.maximum(counts - most, 0).sum(1)
    counts = np.minimum(counts, most) + (over // 256)[:, None]
    for c, left in zip(counts, over % 256):  # the rest, one to a level, evenly spaced
        if left:
            c[: left * (256 // left) : 256 // left] += 1
    tables = np.clip(np.rint(counts.cumsum(1) * (255.0 / (th * tw))), 0, 255).reshape(tiles, tiles, 256)

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        first = np.floor(at).astype(int)
        return np.clip(first, 0, tiles - 1), np.clip(first + 1, 0, tiles - 1), at - first

    (r0, r1, fr), (c0, c1, fc) = between(h, th), between(w, tw)
    v = image.astype(np.int64)
    of = lambda r, c: tables[r[:, None], c[None, :], v]
    upper, lower = of(r0, c0) * (1 - fc) + of(r0, c1) * fc, of(r1, c0) * (1 - fc) + of(r1, c1) * fc
    return np.clip(np.rint(upper * (1 - fr[:, None]) + lower * fr[:, None]), 0, 255)


def non_local_mean(image: np.ndarray, strength: float = 10.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Each pixel as the mean of those around it, weighted by how alike their patches are."""
    h, w = image.shape
    p, s = patch // 2, search // 2
    wide = np.pad(image, p + s, mode="reflect" if min(h, w) > p + s else "edge")
    middle = wide[s : s + h + 2 * p, s : s + w + 2 * p]
    total, weights = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(search):
        for dx in range(search):
            other = wide[dy : dy + h + 2 * p, dx : dx + w + 2 * p]
            sums = np.pad((middle - other) ** 2, [(1, 0), (1, 0)]).cumsum(0).cumsum(1)
            unlike = (sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]) / patch**2
            weight = np.exp(-np.maximum(unlike, 0) / strength**2)
            weight[weight < 0.001] = 0
            total += weight * other[p : p + h, p : p + w]
            weights += weight
    return np.rint(total / weights)


def prepare(image: np.ndarray, preset: str, range_m: float | None, altitude_m: float | None, display: bool) -> tuple[np.ndarray, list[str]]:
    """The image after the steps of a preset (an unknown one counts as light), and the names of the steps."""
    cfg = PRESETS.get(preset, PRESETS["light"])
    lo, hi = np.percentile(image, (1, 99))
    out = np.floor(np.clip((image - lo) * (255 / (hi - lo)), 0, 255) + 1e-6) if hi > lo else np.zeros_like(image)
    steps = [STEPS["stretch"]]
    if cfg["despeckle"]:
        out = (median3 if cfg["despeckle"] == "median3" else non_local_mean)(out)
        steps.append(STEPS[cfg["despeckle"]])
    if cfg["clahe"]:
        out = equalised(out, cfg["clahe"])
        steps.append(STEPS["clahe"].format(cfg["clahe"]))
    rows = np.arange(len(out), dtype=float)
    ground = lambda full: np.sqrt(np.maximum((full * rows / max(len(out) - 1, 1)) ** 2 - altitude_m**2, 0))
    if cfg["tvg"] and range_m and altitude_m:
        g = ground(max(range_m, 1.0))
        gain = np.clip((g / max(g.max(), 1e-6)) ** 2, GAIN_LOW, GAIN_HIGH)
        out = np.floor(np.clip(out * gain[:, None], 0, 255) + 1e-6)
        steps.append(STEPS["tvg"])
    if display and range_m and altitude_m and 0 < altitude_m < range_m and len(out) > 1:
        g = ground(range_m)
        out = out[np.rint(np.interp(np.linspace(g[0], g[-1], len(out)), g, rows).round(6)).astype(int)]
        steps.append(STEPS["slant"])
    return out, steps


def _per_image(images: DataFrame, extra: list[str], schema: str, rows_of: Callable) -> DataFrame:
    """rows_of(row, image) for each of (image_id, data, height, width and extra columns), data 8-bit grey; null data gives no row."""
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([x for r in rows.itertuples() for x in rows_of(r, grey(r.data, r.height, r.width))], columns=names)

    return images.where("data is not null").select("image_id", "data", "height", "width", *extra).mapInPandas(work, schema)


def prepared(images: DataFrame, meta: DataFrame, preset: str = "light", display: bool = False) -> DataFrame:
    """(image_id, data, height, width, steps) of (image_id, data, height, width) after a preset; steps names, in order, what was done.

    meta: (image_id, range_m, altitude_m), one row an image at most. display: the rows are then spaced by ground range.
    """
    rows = images.join(meta.select("image_id", F.col("range_m").cast("double"), F.col("altitude_m").cast("double")), "image_id", "left")

    def one(r, image):
        known = [None if pd.isna(x) else float(x) for x in (r.range_m, r.altitude_m)]
        out, steps = prepare(image, preset, *known, display)
        yield r.image_id, out.astype(np.uint8).tobytes(), r.height, r.width, steps

    return _per_image(rows, ["range_m", "altitude_m"], "image_id long, data binary, height int, width int, steps array<string>", one)


def segment(image: np.ndarray, box: tuple[float, float, float, float], k: float = SEGMENT_K) -> tuple[tuple[int, int, int, int], np.ndarray, float]:
    """The box within the image, the mask of its largest bright region, and the share of the box that it covers.

    Bright is what exceeds the median outside a ring around the box by k deviations; if less than RING_PIXELS lie there, the 30th
    percentile and 0.6 deviations of the box itself count. If nothing is that bright, SEGMENT_WEAK_K deviations do.
    """
    height, width = image.shape
    x, y, w, h = box
    x0, y0, x1, y1 = max(0, int(x)), max(0, int(y)), min(width, int(x + w)), min(height, int(y + h))
    if x1 <= x0 or y1 <= y0:
        return (x0, y0, x0, y0), np.zeros((0, 0), bool), 0.0
    pad = max(6, int(0.5 * max(x1 - x0, y1 - y0)))
    far = np.ones(image.shape, bool)
    far[max(0, y0 - pad) : y1 + pad, max(0, x0 - pad) : x1 + pad] = False
    crop, back = image[y0:y1, x0:x1], image[far]
    level, sd = (float(np.median(back)), float(back.std())) if back.size >= RING_PIXELS else (float(np.percentile(crop, 30)), float(crop.std()) * 0.6)
    mask = crop > level + k * max(sd, 1.0)
    if not mask.any():
        mask = crop > level + SEGMENT_WEAK_K * sd
    mask = _narrowest(_widest(mask, 5), 5)
    mask = _widest(_narrowest(mask, 3), 3)
    found = regions(mask)
    only = np.zeros(mask.shape, bool)
    for r, a, b in max(found, key=lambda runs: bounds(runs)[4], default=[]):
        only[r, a:b] = True
    return (x0, y0, x1, y1), only, round(float(only.sum()) / only.size, 4)


def straight_share(mask: np.ndarray, least: int = 6) -> float:
    """Share of a mask's border pixels in runs of at least `least` along a row, a column or a diagonal."""
    p = np.pad(mask, 1)
    border = mask & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])
    if not border.any():
        return 0.0
    on = set(zip(*(x.tolist() for x in np.nonzero(border))))
    straight = set()
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        for y, x in on:
            if (y - dy, x - dx) not in on:
                run = [(y, x)]
                while (run[-1][0] + dy, run[-1][1] + dx) in on:
                    run.append((run[-1][0] + dy, run[-1][1] + dx))
                straight.update(run if len(run) >= least else ())
    return len(straight) / len(on)


def mask_features(crop: np.ndarray, mask: np.ndarray, corner: tuple[int, int]) -> tuple[float, float, float, float]:
    """variation, difference, solidity and straightness of a masked crop whose first column and row in the image are `corner`.

    The surroundings are what the mask leaves of the crop, but for the crop's last rows and columns, as many as the margin (a third
    of the shorter side, at least 4) or as lie before the crop in the image.
    """
    inside = crop[mask]
    variation = float(inside.std()) / (float(inside.mean()) + 1e-6) if inside.size > 20 else 0.4
    pad = max(4, min(crop.shape) // 3)
    around = ~mask
    around[tuple(slice(-min(at, pad) if at else 0, None) for at in corner[::-1])] = False
    difference = (float(inside.mean()) if inside.size else 0.0) - (float(crop[around].mean()) if around.any() else 0.0)
    solidity = float(mask.sum()) / max(max((hull_area(r) for r in regions(mask)), default=0.0), 1.0) if mask.any() else 0.0
    return variation, difference, solidity, straight_share(mask)


def segments(images: DataFrame, detections: DataFrame, k: float = SEGMENT_K) -> DataFrame:
    """(image_id, detection_id, area_fraction, variation, difference, solidity, straightness) of each box of (image_id, detection_id, x, y, w, h).

    images: (image_id, data, height, width), 8-bit grey. The boxes of an image join its row as one array. A box outside its image
    has fraction 0 and null features; one without an image gives no row.
    """
    boxes = detections.groupBy("image_id").agg(F.collect_list(F.struct("detection_id", *[F.col(c).cast("double").alias(c) for c in "xywh"])).alias("boxes"))

    def each(r, image):
        for b in r.boxes:
            (x0, y0, x1, y1), mask, share = segment(image, (b["x"], b["y"], b["w"], b["h"]), k)
            yield r.image_id, b["detection_id"], share, *(mask_features(image[y0:y1, x0:x1], mask, (x0, y0)) if mask.size else (None,) * 4)

    kind = detections.schema["detection_id"].dataType.simpleString()
    return _per_image(images.join(boxes, "image_id"), ["boxes"], f"image_id long, detection_id {kind}, area_fraction double, variation double, difference double, solidity double, straightness double", each)


def crops(images: DataFrame, detections: DataFrame, pad: float = CROP_PAD, side: int = CROP_SIDE) -> DataFrame:
    """(image_id, detection_id, data, height, width): the padded crop of each box, by the bounds of `crop_bounds`."""
    placed = crop_bounds(images.join(detections.select("image_id", "detection_id", "x", "y", "w", "h"), "image_id"), F.col("width"), F.col("height"), pad, side)
    at = placed.groupBy("image_id").agg(F.collect_list(F.struct("detection_id", "x0", "y0", "x1", "y1")).alias("boxes"))

    def each(r, image):
        for b in r.boxes:
            part = image[b["y0"] : b["y1"], b["x0"] : b["x1"]]
            yield r.image_id, b["detection_id"], part.astype(np.uint8).tobytes(), *part.shape

    kind = detections.schema["detection_id"].dataType.simpleString()
    return _per_image(images.join(at, "image_id"), ["boxes"], f"image_id long, detection_id {kind}, data binary, height int, width int", each)
