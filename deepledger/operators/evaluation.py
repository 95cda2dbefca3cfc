"""Detection and classification metrics, calibration, data splits and label checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
#: Rows of one partition where rows are few bytes each.
ROWS_A_TASK = 1_000_000


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every (x, y, w, h) row of a with every row of b."""
    wide = np.minimum((a[:, 0] + a[:, 2])[:, None], b[:, 0] + b[:, 2]) - np.maximum(a[:, 0][:, None], b[:, 0])
    tall = np.minimum((a[:, 1] + a[:, 3])[:, None], b[:, 1] + b[:, 3]) - np.maximum(a[:, 1][:, None], b[:, 1])
    inner = np.maximum(0, wide) * np.maximum(0, tall)
    return inner / np.maximum((a[:, 2] * a[:, 3])[:, None] + b[:, 2] * b[:, 3] - inner, 1e-9)


def _by_image(rows: DataFrame, tag: int) -> DataFrame:
    id_, score = ("detection_id", F.col("score")) if tag == 0 else ("truth_id", F.lit(0.0))
    return rows.where("image_id is not null").select("image_id", F.col(id_).alias("id"), *[F.col(c).cast("double").alias(c) for c in "xywh"], score.cast("double").alias("score"), F.lit(tag).alias("tag"))


def _streamed(rows: DataFrame) -> DataFrame:
    """rows with those of an image next to each other, by tag, descending score and id: a task sorts, and spills, but holds only an image at a time.

    They are dealt by a hash of the image, not by the image itself: over a union of joins by image Spark would take that for done and
    leave it out, and adaptive execution may have merged the partitions of the joins differently.
    """
    return rows.repartition(F.xxhash64("image_id")).sortWithinPartitions("image_id", "tag", F.desc("score"), "id")


def _images(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, slice, pd.DataFrame, np.ndarray]]]:
    """The images (id, their rows in a batch, the batch, boxes) that end in each batch of `_streamed`, an image that goes on in the next one being kept for it."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        ids = batch["image_id"].to_numpy()
        if not len(ids):
            continue
        if rest and ids[0] == rest[0]["image_id"].iat[0] and ids[-1] == ids[0]:
            rest.append(batch)
            continue
        batch = pd.concat([*rest, batch], ignore_index=True)
        ids, boxes = batch["image_id"].to_numpy(), batch[["x", "y", "w", "h"]].to_numpy(dtype=float)
        at = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()]
        yield [(ids[i], slice(i, j), batch, boxes[i:j]) for i, j in zip(at, at[1:])]
        rest = [batch.iloc[at[-1] :]]
    if rest:
        batch = pd.concat(rest, ignore_index=True)
        yield [(batch["image_id"].iat[0], slice(0, len(batch)), batch, batch[["x", "y", "w", "h"]].to_numpy(dtype=float))]


def greedy_match(detections: DataFrame, truths: DataFrame, least: float = 0.5) -> DataFrame:
    """(image_id, tp, fp, fn): detections by descending score (ties by id) each take the unused truth they overlap most. Rows of null image take no part."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for images in _images(batches):
            out = []
            for image, place, batch, boxes in images:
                found = int((batch["tag"].to_numpy()[place] == 0).sum())
                used = np.zeros(len(boxes) - found, bool)
                for i in range(found if len(used) else 0):
                    free = np.where(used, -1.0, box_iou(boxes[i : i + 1], boxes[found:])[0])
                    if free.max() >= least:
                        used[free.argmax()] = True
                tp = int(used.sum())
                out.append((image, tp, found - tp, len(used) - tp))
            yield pd.DataFrame(out, columns=["image_id", "tp", "fp", "fn"])

    return _streamed(_by_image(detections, 0).unionByName(_by_image(truths, 1))).mapInPandas(match, "image_id long, tp long, fp long, fn long")


def precision_recall(matches: DataFrame) -> DataFrame:
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    rows = matches.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count("*").alias("images"), F.count_if(F.col("fp") > 0).alias("images_with_fp"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"), F.round(F.col("fp") / F.col("images"), 4).alias("fp_per_image"))


#: The fields of one set in an evaluation document, in order.
SET_FIELDS = ("manifest", "images", "gt_objects", "tp", "fp", "fn", "precision", "recall", "f1", "false_alarms_per_image", "images_with_false_alarms")


def metrics_documents(matches: DataFrame, sets: DataFrame) -> DataFrame:
    """(part, manifest, body): the JSON documents of an evaluation, one for each set of images and one of all together.

    matches: those of greedy_match; sets: (image_id, manifest). An image without detections and truths counts as one of its set; one of
    no set counts for all together alone. Part is `sets` or, with null manifest, `combined`.
    """
    rows = sets.dropDuplicates(["image_id"]).join(matches, "image_id", "full_outer").select("manifest", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    counts = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    each = rows.where("manifest is not null").groupBy("manifest").agg(*counts, F.count("*").alias("images"), F.count_if(F.col("fp") > 0).alias("images_with_false_alarms"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    each = each.withColumns({
        "gt_objects": F.col("tp") + F.col("fn"), "precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(ratio(2 * p * r, p + r), 4), "false_alarms_per_image": F.round(F.col("fp") / F.col("images"), 3),
    })
    sets_of = each.select(F.lit("sets").alias("part"), "manifest", F.to_json(F.struct(*SET_FIELDS)).alias("body"))
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("tp", "fp", "fn")])
    return sets_of.unionByName(total.select(F.lit("combined").alias("part"), F.lit(None).cast("string").alias("manifest"), F.to_json(F.struct("tp", "fp", "fn"), {"ignoreNullFields": "false"}).alias("body")))


def suppress(detections: DataFrame, most: float = 0.45) -> DataFrame:
    """(image_id, detection_id) that no better one of their image (score, then id) which is kept overlaps by more than `most`, whatever the class. Rows of null image take no part."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for images in _images(batches):
            out = []
            for image, place, batch, boxes in images:
                live, names = np.ones(len(boxes), bool), batch["id"].to_numpy()[place]
                for i in range(len(boxes)):
                    if live[i]:
                        out.append((image, names[i]))
                        if i + 1 < len(boxes):
                            live[i + 1 :] &= box_iou(boxes[i : i + 1], boxes[i + 1 :])[0] <= most
            yield pd.DataFrame(out, columns=["image_id", "detection_id"])

    return _streamed(_by_image(detections, 0)).mapInPandas(keep, "image_id long, detection_id string")


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, gap) of rows (confidence, label): equal bins, the first closed on both sides, others open below."""
    b = F.greatest(F.lit(0), F.ceil(F.col("confidence") * bins) - 1)
    rows = scored.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg("label").alias("a"))
    return rows.select("bin", "n", F.round("c", 6).alias("confidence"), F.round("a", 6).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("a")), 6).alias("gap"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    rows = calibration_bins(scored, bins)
    return rows.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 5).alias("ece"))


def roc_auc(scored: DataFrame, ranges: int = 256) -> DataFrame:
    """Area under the ROC curve, ties counted half, from counts per distinct score.

    The distinct scores are cut into ranges at their approximate quantiles; a window runs within each range and another over the
    sums of the ranges, a row each, so that no task holds more than about one range.
    """
    steps = scored.where("confidence is not null").groupBy("confidence").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    edges = sorted(set(steps.agg(F.percentile_approx("confidence", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or ()))
    part = F.size(F.filter(F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>"), lambda e: e < F.col("confidence")))
    steps = steps.withColumn("part", part)
    before = lambda window: F.coalesce(F.sum("q").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = steps.groupBy("part").agg(F.sum("q").alias("q")).select("part", before(Window.orderBy("part")).alias("lower"))  # a row for each range
    rows = steps.join(F.broadcast(lower), "part").withColumn("below", F.col("lower") + before(Window.partitionBy("part").orderBy("confidence")))
    return rows.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.round(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")), 6).alias("auc"))


def threshold_sweep(scored: DataFrame, steps: int = 20) -> DataFrame:
    """(threshold, tp, fp, fn, f1, accuracy, balanced): one pass counts rows by step, then steps are summed from the top."""
    at = F.least(F.lit(steps), F.floor(F.col("confidence") * steps)).cast("int")
    bins = scored.groupBy(at.alias("step")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    spark = scored.sparkSession
    every = spark.range(steps + 1).select(F.col("id").cast("int").alias("step")).join(bins, "step", "left").fillna(0, ["p", "q"])
    up, all_ = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = every.withColumns({"tp": F.sum("p").over(up), "fp": F.sum("q").over(up), "np": F.sum("p").over(all_), "nn": F.sum("q").over(all_)})
    tpr, tnr = ratio(F.col("tp"), F.col("np")), ratio(F.col("nn") - F.col("fp"), F.col("nn"))
    return rows.select(
        F.round(F.col("step") / steps, 4).alias("threshold"), "tp", "fp", (F.col("np") - F.col("tp")).alias("fn"), F.round(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("np")), 6).alias("f1"),
        F.round(ratio(F.col("tp") + F.col("nn") - F.col("fp"), F.col("np") + F.col("nn")), 6).alias("accuracy"), F.round((tpr + tnr) / 2, 6).alias("balanced"),
    )


def dice(pixels: DataFrame) -> DataFrame:
    """Pooled and per-image mean Dice and IoU of rows (image_id, predicted, truth), 0/1 each."""
    per = pixels.groupBy("image_id").agg(F.sum(F.col("predicted") * F.col("truth")).alias("i"), F.sum("predicted").alias("p"), F.sum("truth").alias("t"))
    one = F.when(F.col("p") + F.col("t") == 0, 1.0).otherwise(2 * F.col("i") / F.nullif(F.col("p") + F.col("t"), F.lit(0)))
    i, p, t = (F.sum(c) for c in "ipt")
    return per.agg(F.round(ratio(2 * i, p + t), 6).alias("pooled_dice"), F.round(ratio(i, p + t - i), 6).alias("pooled_iou"), F.round(F.avg(one), 6).alias("mean_dice"), F.count("*").alias("images"))


def site_split(images: DataFrame, seed: str = "0", share: float = 0.2) -> DataFrame:
    """images (image_id, site) with split: sites in the order of a seeded hash, the first round(share * n) of them for validation, at least one.

    Whole sites go to one side, so near-identical frames never face each other. With fewer than three sites, images are split instead.
    """
    sites = images.select("site").distinct()
    few = sites.count() < 3
    key = "image_id" if few else "site"
    units = images.select(key).distinct() if few else sites
    n = units.count()
    order = Window.orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), key)
    ranked = units.withColumn("split", F.when(F.row_number().over(order) <= max(1, int(share * n + 0.5)), "val").otherwise("train")) if not few else units.withColumn("split", F.when(F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") < share * 2**32, "val").otherwise("train"))
    return images.join(ranked, key)


def split_report(split: DataFrame) -> DataFrame:
    """Counts by split and label and, for training, the positive weight negatives / positives."""
    rows = split.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.count_distinct("site").alias("sites"))
    return rows.withColumn("positive_weight", F.round(F.try_divide(F.col("n") - F.col("positives"), F.col("positives")), 6))


def label_lines(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """A text of normalised `class cx cy w h` lines for each image, six decimals."""
    number = lambda x: F.format_string("%.6f", F.bround(x, 6))  # noqa: E731  ties to even, as C prints them
    line = F.concat_ws(" ", F.col("class_id").cast("string"), number((F.col("x") + F.col("w") / 2) / width), number((F.col("y") + F.col("h") / 2) / height), number(F.col("w") / width), number(F.col("h") / height))
    return boxes.groupBy("image_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"), F.count("*").alias("boxes"))


def label_faults(lines: DataFrame, classes: int = 4) -> DataFrame:
    """Faults of label lines (image_id, line): number of fields, unknown class, coordinates out of range."""
    f = F.split("line", " ")
    number = lambda i: F.get(f, F.lit(i)).try_cast("double")
    outside = F.exists(F.array(*[number(i) for i in range(1, 5)]), lambda v: v.isNull() | (v < 0) | (v > 1))
    cid = F.get(f, F.lit(0)).try_cast("int")
    fault = F.when(F.size(f) != 5, "field count").when(cid.isNull() | (cid < 0) | (cid >= classes), "class id").when(outside, "coordinate range")
    return lines.withColumn("fault", fault).where("fault is not null")


def unmatched(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, what): each row of frames without a label, and once each image of labels without a frame; a null id matches nothing.

    Both meet in one shuffle into so many partitions that each has about ROWS_A_TASK rows: numbers of images are so small when
    compressed that partitions planned by their bytes would hold more rows than a task should.
    """
    flag = lambda rows, frame: rows.select("image_id", F.lit(frame).alias("frame"))
    parts = max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(frames.count() + labels.count()) // ROWS_A_TASK))
    both = flag(frames, True).unionByName(flag(labels, False)).repartition(parts, "image_id").groupBy("image_id").agg(F.count_if("frame").cast("int").alias("frames"), F.bool_or(~F.col("frame")).alias("labelled"))
    bare = F.array_repeat(F.lit("no label"), F.when(F.col("labelled") & F.col("image_id").isNotNull(), 0).otherwise(F.col("frames")))
    alone = F.when(F.col("labelled") & ((F.col("frames") == 0) | F.col("image_id").isNull()), F.array(F.lit("no frame"))).otherwise(F.array().cast("array<string>"))
    return both.select("image_id", F.explode(F.concat(bare, alone)).alias("what"))
