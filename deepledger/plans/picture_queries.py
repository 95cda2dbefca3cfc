"""Queries over pictures as pixel tables and over boxes in them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deepledger.operators import images as I
from deepledger.operators import pictures as P
from deepledger.operators import regions as R
from deepledger.plans.model_queries import PIXELS
from deepledger.plans.region_oracles import BOX_SHADOWS, BOX_STATISTICS, MASK_BOXES, MASK_LEVEL, TALL
from deepledger.sources import adapters as A

#: Pictures made of vectors have 8 rows; their tiles are as high and overlap by a quarter.
SIDE, STEP = 8, 6


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pixels_of(A.read(spark, sf_dir, "embeddings"))


def picture_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stretched(_pixels(spark, sf_dir))


def picture_range_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gained(_pixels(spark, sf_dir), A.frames(spark, sf_dir))


def picture_ground_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ground_spaced(_pixels(spark, sf_dir), A.frames(spark, sf_dir))


def tiled_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel scores, in each tile, the logistic of its levels above the tile's mean over 16."""
    tiles = P.on_tiles(_pixels(spark, sf_dir), SIDE, STEP)
    mean = tiles.groupBy("image_id", "tile_row", "tile_col").agg(F.avg("v").alias("m"))
    scored = tiles.join(mean, ["image_id", "tile_row", "tile_col"], "left")
    return P.tile_mean(scored.withColumn("p", 1 / (1 + F.exp((F.col("m") - F.col("v")) / 16))))


def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.detections(spark, sf_dir).select("image_id", "detection_id", "x", "y", "w", "h")
    return P.crop_bounds(d, F.lit(A.IMAGE_HEIGHT), F.lit(A.IMAGE_HEIGHT)).select("image_id", "detection_id", "x0", "y0", "x1", "y1")


def artificial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with numbers of theirs as features: scores of features and of two logits."""
    d = A.detections(spark, sf_dir)
    parts = P.feature_scores(F.col("mask_frac") / 2, F.col("y") / 4, F.col("natural"), F.col("class_confidence") / 2)
    return d.select("image_id", "detection_id", P.artificial(parts, F.col("anomaly")).alias("p_features"), P.softmax_artificial(F.col("w") / 10, F.col("h") / 10).alias("p_logits"))


def _tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pixels_of(A.read(spark, sf_dir, "embeddings"), TALL)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of every detection, in the pictures in turn; some reach beyond the border."""
    pictures = A.read(spark, sf_dir, "embeddings").agg(F.floor(F.max("vec_id") / TALL) + 1).first()[0]
    d = A.detections(spark, sf_dir)
    part = lambda c, of, least: (F.col(c).cast("long") % of + least).alias(c)
    return d.select((F.col("image_id") % F.lit(pictures)).alias("image_id"), F.col("detection_id").alias("box"), part("x", TALL, -3), part("y", TALL, -3), part("w", 7, 1), part("h", 9, 1))


def mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mask_boxes(_tall(spark, sf_dir).where(F.col("v") > MASK_LEVEL))


def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.box_statistics(_tall(spark, sf_dir), _boxes(spark, sf_dir)).select("image_id", "box", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def box_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.box_shadows(_tall(spark, sf_dir), _boxes(spark, sf_dir), A.frames(spark, sf_dir))
    return out.withColumn("evidence", F.round("evidence", 6))


QUERIES = {f.__name__: f for f in (mask_boxes, box_statistics, box_shadows, picture_stretch, picture_range_gain, picture_ground_rows, tiled_average, crop_boxes, artificial_scores)}

_META = f"""{A.FRAMES}, {PIXELS}, m as (select p.*, max("row") over (partition by image_id)::double as last, range_m, altitude_m from pixels p left join frames using (image_id))"""


def _ground(slant: str) -> str:
    return f"sqrt(greatest(0.0::double, ({slant}) * ({slant}) - altitude_m * altitude_m))"


_LAST = _ground("greatest(range_m, 1.0::double)")

ORACLES = {
    "mask_boxes": MASK_BOXES, "box_statistics": BOX_STATISTICS, "box_shadows": BOX_SHADOWS,
    "picture_stretch": f"""with {PIXELS}, s as (select image_id, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from pixels group by 1)
        select image_id, "row", col, case when hi > lo then floor(round(greatest(0.0::double, least(255.0::double, (v - lo) * 255 / (hi - lo))), 6))::int else 0 end as v from pixels join s using (image_id)""",
    "picture_range_gain": f"""with {_META}, g as (select *, {_ground('greatest(range_m, 1.0::double) * "row" / greatest(last, 1)')} / greatest({_LAST}, 1e-6::double) as share from m)
        select image_id, "row", col, case when range_m <> 0 and altitude_m <> 0 then floor(round(least(255.0::double, v * greatest(0.5::double, least(4.0::double, share * share))), 6))::int else v end as v from g""",
    "picture_ground_rows": f"""with {_META}, i as (select distinct image_id, range_m, altitude_m, last, coalesce(altitude_m > 0 and altitude_m < range_m and last > 0, false) as fit from m), r as (select unnest(range(0, 8)) as k),
        g as (select image_id, k, {_ground('range_m * k / last')} as g from i, r where fit and k <= last), o as (select image_id, k as out_row, fit, {_ground('range_m')} * k / last as spot, last from i, r where k <= last),
        b as (select o.image_id, out_row, any_value(spot) as spot, max(k) filter (where g <= spot + 1e-9::double and k < last) as k0 from o join g using (image_id) where fit group by 1, 2),
        s as (select b.image_id, out_row, round_even(round(k0 + (spot - x.g) / (y.g - x.g), 6), 0)::int as "row" from b join g x on x.image_id = b.image_id and x.k = k0 join g y on y.image_id = b.image_id and y.k = k0 + 1),
        t as (select * from s union all select image_id, out_row, out_row from o where not fit)
        select image_id, out_row as "row", col, v from t join pixels using (image_id, "row")""",
    "tiled_average": f"""with {PIXELS}, starts as (select unnest(range(0, 57, {STEP})) as tile_col), t as (select * from pixels join starts on tile_col <= col and col < tile_col + {SIDE}),
        m as (select image_id, tile_col, avg(v) as m from t group by all), p as (select image_id, "row", col, avg(1 / (1 + exp((m - v) / 16))) as p from t join m using (image_id, tile_col) group by all)
        select image_id, "row", col, round(coalesce(p, 0), 6) as p, round(coalesce(p, 0), 6) > 0.5 as predicted from pixels left join p using (image_id, "row", col)""",
    "crop_boxes": f"""with {A.DETECTIONS}, c as (select image_id, detection_id, greatest(0, trunc(x - 0.08::double * w))::int as x0, greatest(0, trunc(y - 0.08::double * h))::int as y0,
            least({A.IMAGE_HEIGHT}, trunc(x + w * 1.08::double))::int as x1, least({A.IMAGE_HEIGHT}, trunc(y + h * 1.08::double))::int as y1 from detections)
        select * from c where x1 - x0 >= 8 and y1 - y0 >= 8""",
    "artificial_scores": f"""with {A.DETECTIONS}, f as (select *, greatest(0.0::double, least(1.0::double, 1 - mask_frac / 2 / 0.3::double)) as f1, greatest(0.0::double, least(1.0::double, y / 4 / 80)) as f2,
            greatest(0.0::double, least(1.0::double, (natural_ - 0.35::double) / 0.45::double)) as f3, greatest(0.0::double, least(1.0::double, class_confidence / 2 / 0.5::double)) as f4 from detections),
        p as (select *, floor(round(greatest(0.05::double, least(0.95::double, 0.38::double * f1 + 0.22::double * f2 + 0.24::double * f3 + 0.16::double * f4)) * 1000, 6) + 0.5::double) / 1000 as p from f)
        select image_id, detection_id, case when anomaly between 0.06::double and 0.60::double then least(0.95::double, p + 0.1::double) else p end as p_features,
            round(greatest(0.05::double, least(0.95::double, 1 / (1 + exp(w / 10 - h / 10)))), 3) as p_logits from p""",
}
