"""Survey tables derived from the driver's tables, each as DataFrame functions and as DuckDB SQL.

frames from orders, detections from lineitem and frames, navigation from events. All are deterministic projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE_HEIGHT = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per order; a customer is a survey. Frame metadata are functions of the keys, with gaps."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key, survey = F.col("o_orderkey"), F.col("o_custkey")
    fix = key % 17 != 0
    return read(spark, sf_dir, "orders").select(
        survey.alias("survey_id"), key.alias("image_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_index"), F.col("o_orderdate").alias("captured_at"),
        F.when(fix, 54 + (survey % 100) * 0.01).alias("vessel_lat"), F.when(fix, 10 + (survey % 50) * 0.01).alias("vessel_lon"),
        ((key * 7) % 360).cast("double").alias("heading_deg"), (survey % 16).cast("double").alias("altitude_m"), (40 + key % 61).cast("double").alias("range_m"),
        F.when(key % 3 == 0, "port").when(key % 3 == 1, "starboard").otherwise("unknown").alias("side"),
        F.when(key % 5 == 0, 20.0).alias("layback_m"), F.when(key % 7 == 0, (key % 11 - 5).cast("double")).alias("roll_deg"), F.when(key % 13 == 0, 2.0).alias("pitch_deg"),
    )


FRAMES = """frames as (
    select o_custkey as survey_id, o_orderkey as image_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as frame_index, o_orderdate as captured_at,
        case when o_orderkey % 17 <> 0 then 54 + (o_custkey % 100) * 0.01::double end as vessel_lat, case when o_orderkey % 17 <> 0 then 10 + (o_custkey % 50) * 0.01::double end as vessel_lon,
        ((o_orderkey * 7) % 360)::double as heading_deg, (o_custkey % 16)::double as altitude_m, (40 + o_orderkey % 61)::double as range_m,
        case o_orderkey % 3 when 0 then 'port' when 1 then 'starboard' else 'unknown' end as side,
        case when o_orderkey % 5 = 0 then 20.0::double end as layback_m, case when o_orderkey % 7 = 0 then (o_orderkey % 11 - 5)::double end as roll_deg, case when o_orderkey % 13 = 0 then 2.0::double end as pitch_deg
    from orders)"""


def frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height of each frame's picture; some are not known."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(key.alias("image_id"), F.when(key % 23 != 0, 640 + 384 * (key % 2)).alias("width"), F.when(key % 23 != 0, F.lit(IMAGE_HEIGHT)).alias("height"))


FRAME_SIZES = f"""sizes as (select o_orderkey as image_id, case when o_orderkey % 23 <> 0 then 640 + 384 * (o_orderkey % 2) end as width, case when o_orderkey % 23 <> 0 then {IMAGE_HEIGHT} end as height from orders)"""


def detection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their frame's survey and index, of which detections are made."""
    used = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), *used)
    return rows.join(frames(spark, sf_dir).select("image_id", "survey_id", "frame_index"), "image_id")


def detection_columns() -> dict[str, Column]:
    """The columns of a detection by name, from those of its row. Positions and two signals are null for some."""
    return {
        "image_id": F.col("image_id"),
        "detection_id": F.concat_ws("_", F.lit("det"), "image_id", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")),
        "class_name": F.when(F.col("l_suppkey") % 4 == 0, "wreck").when(F.col("l_suppkey") % 4 == 1, "debris").when(F.col("l_suppkey") % 4 == 2, "structure").otherwise("tire"),
        "class_confidence": F.round(F.col("l_discount") * 10, 4), "x": F.col("l_quantity") * 8, "y": (F.col("l_partkey") % 400).cast("double"),
        "w": (10 + F.col("l_suppkey") % 50).cast("double"), "h": (8 + 6 * F.col("l_linenumber")).cast("double"), "mask_frac": F.round(F.col("l_tax") * 10, 4),
        "natural": (F.col("l_partkey") % 100) / 100, "anomaly": (F.col("l_suppkey") % 11) / 10,
        "shadow": F.when(F.col("l_returnflag") != "N", F.round(0.5 + F.col("l_discount") * 4, 4)), "physics": F.when(F.col("l_linestatus") != "O", F.round(1 - F.col("l_tax") * 10, 4)),
        "lat": F.when(F.col("l_linenumber") % 5 != 0, 54 + (F.col("l_partkey") % 200) * 1e-5), "lon": F.when(F.col("l_linenumber") % 5 != 0, 10 + (F.col("l_suppkey") % 50) * 1e-5),
        "uncertainty_m": F.when(F.col("l_linenumber") % 5 != 0, (F.col("l_quantity") % 9).cast("double")),
        "survey_id": F.col("survey_id"), "frame_index": F.col("frame_index"),
    }


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection per line item, with its frame's survey and index."""
    # columns are derived after the join, so that the narrower ones of the table are shuffled
    return detection_rows(spark, sf_dir).select(*[v.alias(k) for k, v in detection_columns().items()])


DETECTIONS = FRAMES + """, detections as (
    select l_orderkey as image_id, concat_ws('_', 'det', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int) as detection_id,
        ['wreck', 'debris', 'structure', 'tire'][1 + l_suppkey % 4] as class_name, round(l_discount * 10, 4) as class_confidence, l_quantity * 8 as x, (l_partkey % 400)::double as y,
        (10 + l_suppkey % 50)::double as w, (8 + 6 * l_linenumber)::double as h, round(l_tax * 10, 4) as mask_frac, (l_partkey % 100) / 100 as natural_, (l_suppkey % 11) / 10 as anomaly,
        case when l_returnflag <> 'N' then round(0.5::double + l_discount * 4, 4) end as shadow, case when l_linestatus <> 'O' then round(1 - l_tax * 10, 4) end as physics,
        case when l_linenumber % 5 <> 0 then 54 + (l_partkey % 200) * 1e-5::double end as lat, case when l_linenumber % 5 <> 0 then 10 + (l_suppkey % 50) * 1e-5::double end as lon,
        case when l_linenumber % 5 <> 0 then l_quantity % 9 end as uncertainty_m, survey_id, frame_index
    from lineitem join frames on l_orderkey = image_id)"""


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw navigation fixes from view and click events, with missing and invalid values."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("survey_id"), F.col("event_id").alias("fix_id"), "ts",
        F.when(F.col("event_id") % 37 == 0, None).when(F.col("event_id") % 41 == 0, 95.0).otherwise(17 + k * 1e-3).alias("lat"), (78 + F.col("value") * 1e-4).alias("lon"),
        (k * 5).cast("double").alias("heading_deg"), F.when(F.col("event_id") % 43 != 0, F.col("value") / 10).alias("altitude_m"), F.lit(3.0).alias("accuracy_m"),
    )


NAVIGATION = """navigation as (
    select user_id as survey_id, event_id as fix_id, ts,
        case when event_id % 37 = 0 then null when event_id % 41 = 0 then 95.0::double else 17 + json_extract_string(props, '$.k')::int * 1e-3::double end as lat, 78 + value * 1e-4::double as lon,
        (json_extract_string(props, '$.k')::int * 5)::double as heading_deg, case when event_id % 43 <> 0 then value / 10 end as altitude_m, 3.0::double as accuracy_m
    from events where event_type in ('view', 'click'))"""


def frame_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at which frames were taken: purchase events."""
    return read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("survey_id"), F.col("event_id").alias("frame_id"), "ts")


FRAME_CLOCK = """clock as (select user_id as survey_id, event_id as frame_id, ts from events where event_type = 'purchase')"""
