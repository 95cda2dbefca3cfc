import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from deepledger.operators import evaluation as E

COLS = "image_id long, detection_id string, x double, y double, w double, h double, score double"


def iou(a, b):
    inner = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return inner / (a[2] * a[3] + b[2] * b[3] - inner)


@pytest.fixture
def boxes():
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2, 3, 4 + i % 40]), f"d{i:03d}", float(r.randrange(30)), float(r.randrange(10)), 10.0, 12.0, r.choice([0.2, 0.5, 0.9])) for i in range(300)]
    return rows + [(None, "x", 0.0, 0.0, 1.0, 1.0, 0.5)]


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_suppress_and_match_against_loops(spark, boxes, batch):
    groups = defaultdict(list)
    for d in boxes[:-1]:
        groups[d[0]].append(d)
    kept, counts = set(), {}
    for image, own in groups.items():
        mine, free, tp = [], [d for d in own if d[1] < "d100"], 0
        truths, n = list(free), len(free)
        for d in sorted(own, key=lambda d: (-d[6], d[1])):
            if all(iou(d[2:6], k[2:6]) <= 0.45 for k in mine):
                mine.append(d)
            best = max(free, key=lambda t: iou((d[2] + 1, *d[3:6]), t[2:6]), default=None)
            if best and iou((d[2] + 1, *d[3:6]), best[2:6]) >= 0.5:
                free.remove(best)
                tp += 1
        kept |= {(image, d[1]) for d in mine}
        counts[image] = (tp, len(own) - tp, n - tp)
        assert len(truths) == n
    df = spark.createDataFrame(boxes, COLS)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert {tuple(r) for r in E.suppress(df).collect()} == kept and E.suppress(df.limit(0)).count() == 0
        truths = df.where("detection_id < 'd100'").withColumnRenamed("detection_id", "truth_id")
        got = {r[0]: tuple(r)[1:] for r in E.greedy_match(df.selectExpr("image_id", "detection_id", "x + 1 as x", "y", "w", "h", "score"), truths).collect()}
        assert got == counts
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_auc_of_many_scores(spark):
    r = random.Random(1)
    rows = [(r.random() if i % 3 else 0.25, int(r.random() < 0.4)) for i in range(900)]
    pos, neg = [c for c, y in rows if y], [c for c, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "confidence double, label int")
    assert E.roc_auc(df, ranges=16).first()["auc"] == pytest.approx(want, abs=1e-6) == E.roc_auc(df, ranges=2).first()["auc"]
    assert E.roc_auc(df.limit(0)).first()["auc"] is None


def test_metrics_documents_of_sets_and_of_all(spark):
    import json

    from deepledger.operators import evaluation

    matches = spark.createDataFrame([(1, 1, 1, 0), (2, 0, 2, 1), (9, 3, 0, 0)], "image_id long, tp long, fp long, fn long")
    sets = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "image_id long, manifest string")
    got = {r["manifest"]: json.loads(r["body"]) for r in evaluation.metrics_documents(matches, sets).collect()}
    assert got[None] == {"tp": 4, "fp": 3, "fn": 1}
    assert tuple(got["a"]) == evaluation.SET_FIELDS
    assert got["a"] == {"manifest": "a", "images": 3, "gt_objects": 2, "tp": 1, "fp": 3, "fn": 1, "precision": 0.25, "recall": 0.5, "f1": 0.3333, "false_alarms_per_image": 1.0, "images_with_false_alarms": 2}
    assert (got["b"]["images"], got["b"]["precision"], got["b"]["false_alarms_per_image"]) == (1, 0.0, 0.0)
    empty = evaluation.metrics_documents(matches.limit(0), sets.limit(0)).collect()
    assert [json.loads(r["body"]) for r in empty] == [{"tp": 0, "fp": 0, "fn": 0}]


def test_greedy_match_keeps_images_whole_over_a_union_of_joins(spark):
    """Both inputs come from joins by image whose partitions adaptive execution merges differently."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    box = [F.lit(v).cast("double").alias(c) for c, v in zip("xywh", (0, 0, 10, 10))]
    images = spark.range(2_000).select(F.col("id").alias("image_id"))
    found = spark.range(8_000).select((F.col("id") % 2_000).alias("image_id"), F.concat(F.lit("detection_"), F.col("id")).alias("detection_id"), *box, F.rand(1).alias("score"))
    truths = spark.range(2_000).select(F.col("id").alias("image_id"), F.col("id").cast("string").alias("truth_id"), *box)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        row = E.precision_recall(E.greedy_match(found.join(images, "image_id"), truths.join(images, "image_id"))).first()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert (row["tp"], row["fp"], row["fn"], row["images"]) == (2_000, 6_000, 0, 2_000)
