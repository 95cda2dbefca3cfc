"""Null-aware scoring: a null signal is not available, so it is left out and the other weights are renormalised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from deepledger.functions import constants as K


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def weighted_mean(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean over the signals that are not null; null if none is."""
    total = reduce(lambda a, b: a + b, (F.coalesce(signals[k] * w, F.lit(0.0)) for k, w in weights.items()))
    return total / weight_used(signals, weights)


def weight_used(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    used = reduce(lambda a, b: a + b, (F.when(signals[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()))
    return F.when(used > 0, used)


def ramp(x: Column, full: float, none: float) -> Column:
    """1 up to `full`, 0 from `none`, linear between."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (none - x) / (none - full))))


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x) by the power that cannot overflow."""
    z = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + z)).otherwise(z / (1 + z))


def calibrated(score: Column, a: float = 1.0, b: float = 0.0) -> Column:
    """A score through a fitted logistic curve with slope a about 0.5 and shift b; null stays null."""
    return F.when(score.isNotNull(), sigmoid(a * (score - 0.5) + b))


def fuse(signals: dict[str, Column], gain: float = K.GAIN, intercept: float = K.INTERCEPT) -> Column:
    """Logistic opinion pool, 4 decimals; 0.0 if nothing is available."""
    mean = weighted_mean(signals, K.FUSION_WEIGHTS)
    return F.coalesce(F.round(1 / (1 + F.exp(-gain * (intercept + mean))), 4), F.lit(0.0))


def fusion_parts(signals: dict[str, Column]) -> dict[str, Column]:
    """What each signal adds to the mean, 4 decimals; null if it is not available."""
    used = weight_used(signals, K.FUSION_WEIGHTS)
    return {k: F.round(signals[k] * w / used, 4) for k, w in K.FUSION_WEIGHTS.items()}


def status(fusion: Column, anomaly: Column, class_confidence: Column) -> Column:
    odd = (F.coalesce(anomaly, F.lit(0.0)) >= 0.8) & (F.coalesce(class_confidence, F.lit(0.0)) < 0.6)
    return F.when(odd, "human_review_required").when(fusion >= K.CONFIRM, "confirmed").when(fusion >= K.REVIEW, "review").otherwise("candidate")


def bell(fraction: Column) -> Column:
    """Segmentation evidence of a mask's share of its box: low for specks and full boxes, 1 between, 0.5 if unknown."""
    return (
        F.when(fraction.isNull(), 0.5)
        .when(fraction < 0.03, 0.1)
        .when(fraction < 0.20, 0.1 + 0.9 * (fraction - 0.03) / 0.17)
        .when(fraction <= 0.65, 1.0)
        .when(fraction < 0.95, 1.0 - 0.7 * (fraction - 0.65) / 0.30)
        .otherwise(0.2)
    )


def risk(class_name: Column, part: int) -> Column:
    """A fixed risk of a class: 0 type, 1 entanglement, 2 environmental; that of "unknown" if it is not listed."""
    out = F.lit(K.RISKS["unknown"][part])
    for name, risks in K.RISKS.items():
        out = F.when(class_name == name, F.lit(risks[part])).otherwise(out)
    return out


def size_factor(width: Column, height: Column) -> Column:
    """Share of a 20 m object that the larger side has; 0.5 if the width is not known."""
    return F.when(width.isNull(), 0.5).otherwise(F.round(F.least(F.lit(1.0), F.greatest(width, F.coalesce(height, F.lit(0.0))) / 20), 3))


def thousandths(x: Column, decimals: int = 4) -> Column:
    """A number of 3 or 4 decimals as whole thousandths, halves up, in integers."""
    whole = F.round(x * 10**decimals).cast("long")
    return whole if decimals == 3 else F.floor((whole + 5) / 10).cast("long")


def priority(class_name: Column, fusion: Column, size: Column, location: float = 0.5) -> Column:
    """0 to 100, one decimal, of factors with three decimals. Integers keep halves exact."""
    factors = {
        "type": F.round(risk(class_name, 0) * 1000).cast("long"), "entanglement": F.round(risk(class_name, 1) * 1000).cast("long"), "environmental": F.round(risk(class_name, 2) * 1000).cast("long"),
        "size": thousandths(size, 3), "confidence": thousandths(fusion), "location": F.lit(round(location * 1000)),
    }
    total = reduce(lambda a, b: a + b, (factors[k] * round(w * 100) for k, w in K.PRIORITY_WEIGHTS.items()))
    return F.floor((total + 50) / 100) / 10


def tier(score: Column) -> Column:
    return reduce(lambda out, t: F.when(score >= t[1], t[0]).otherwise(out), reversed(K.TIERS), F.lit("low"))


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of two (x, y, w, h) boxes; 0 if the union is empty."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    wide = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    tall = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - wide * tall
    return F.when(union > 0, wide * tall / union).otherwise(0.0)


def association(same_class: Column, distance: Column, frame_gap: Column, overlap: Column) -> Column:
    """Match score of a detection and a target, 4 decimals; null distance, gap or overlap: not available."""
    signals = {
        "class": F.when(same_class, 1.0).otherwise(0.0), "geographic": ramp(distance, *K.DISTANCE_RAMP),
        "frame": ramp(frame_gap, *K.FRAME_RAMP), "spatial": ramp(1 - overlap, *K.OVERLAP_RAMP),
    }
    score = weighted_mean(signals, K.ASSOCIATION_WEIGHTS)
    score = score * F.when(same_class, 1.0).otherwise(K.CLASS_PENALTY)
    score = score * F.when(F.round(distance, 1) > K.DISTANCE_RAMP[1], K.GEO_PENALTY).otherwise(1.0)
    apart = (F.round(overlap, 3) <= 0) & (frame_gap <= 1)
    return F.round(score * F.when(apart, K.SPATIAL_PENALTY).otherwise(1.0), 4)


def grazing_angle(altitude: Column, slant: Column) -> Column:
    """Degrees, one decimal; null unless the slant range is at least a positive altitude."""
    return F.when((altitude > 0) & (slant >= altitude), F.round(F.degrees(F.asin(altitude / slant)), 1))


def grazing_score(angle: Column) -> Column:
    """1 within the window of usable angles; from an edge it falls to 0 over half the edge's angle."""
    below = F.greatest(F.lit(0.0), 1 - (K.GRAZING_MIN - angle) / (0.5 * K.GRAZING_MIN))
    above = F.greatest(F.lit(0.0), 1 - (angle - K.GRAZING_MAX) / (0.5 * K.GRAZING_MAX))
    return F.round(F.when(angle < K.GRAZING_MIN, below).when(angle > K.GRAZING_MAX, above).when(angle.isNotNull(), 1.0), 3)


def across_scale(row: Column, height: Column, full_range: Column, altitude: Column) -> Column:
    """Ground metres from an image row to the next, at least 1e-6."""
    from deepledger.functions.geo import ground_range, row_slant

    above = lambda r: ground_range(row_slant(r, height, full_range), altitude)
    return F.greatest(F.lit(1e-6), above(row + 1) - above(row))
