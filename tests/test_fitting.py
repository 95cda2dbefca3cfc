"""Fitted fusion weights against a plain loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from deepledger.functions import scores
from deepledger.operators.fitting import fit_fusion

ROWS = "a double, b double, label double, extra string"


def plain(rows, epochs, rate):
    w, b, g = [0.0, 0.0], 0.0, 1.0
    used = [([0.0 if v is None or math.isnan(v) else v for v in r[:2]], r[2]) for r in rows if r[2] is not None]
    for _ in range(epochs):
        dw, db, dg = [0.0, 0.0], 0.0, 0.0
        for x, y in used:
            z = b + w[0] * x[0] + w[1] * x[1]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, g * z))))
            s = (p - y) * p * (1 - p)
            dw, db, dg = [dw[0] + s * x[0], dw[1] + s * x[1]], db + s, dg + s * z
        n = max(len(used), 1)
        w, b, g = [w[0] - rate * dw[0] / n, w[1] - rate * dw[1] / n], b - rate * db / n, g - rate * dg / n
    return {"a": w[0], "b": w[1], "intercept": b, "gain": g}


def rows():
    r = random.Random(4)
    out = [(round(r.random(), 1), r.choice([None, float("nan"), 0.0, 0.25, 1.0]), float(r.random() < 0.4), "x") for _ in range(300)]
    return out + out[:40] + [(0.5, 0.5, None, "x"), (0.9, 0.1, 0.5, None)]


@pytest.mark.parametrize("one_task", [1 << 18, 0])
def test_fit_equals_a_plain_loop(spark, one_task):
    epochs = 60 if one_task else 6
    got = fit_fusion(spark.createDataFrame(rows(), ROWS).repartition(3), ["a", "b"], epochs=epochs, one_task=one_task)
    assert got == pytest.approx(plain(rows(), epochs, 0.5), abs=1e-12)


def test_fit_learns_the_telling_signal(spark):
    got = fit_fusion(spark.createDataFrame([(float(i % 2), float(i % 3) / 2, float(i % 2), "") for i in range(60)], ROWS), ["a", "b"])
    assert got["a"] > 1 > abs(got["b"])


def test_fit_without_rows(spark):
    assert fit_fusion(spark.createDataFrame([(0.1, 0.1, None, "")], ROWS), ["a", "b"]) == {"a": 0.0, "b": 0.0, "intercept": 0.0, "gain": 1.0}


def test_calibration(spark):
    rows = spark.createDataFrame([(None,), (0.5,), (1.0,), (-2000.0,), (2000.0,)], "s double").select("s", scores.calibrated(F.col("s"), 2.0, 0.1).alias("c")).collect()
    assert rows[0]["c"] is None and [r["c"] for r in rows[1:]] == pytest.approx([1 / (1 + math.exp(-0.1)), 1 / (1 + math.exp(-1.1)), 0.0, 1.0])
