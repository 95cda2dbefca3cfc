"""Queries that write survey tables to a store and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deepledger.operators import evaluation as E
from deepledger.plans import model_queries as M
from deepledger.sources import adapters as A
from deepledger.sources.navigation_source import read_navigation_files
from deepledger.sources.sinks import write_documents
from deepledger.sources.store import Change, Store, shared_folder


def published_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and fixes of each survey after two publications, with the counts of the first.

    The second replaces, at once, the detections of every fifth survey by its confident ones and the fixes of the odd surveys by
    those above altitude 20, of which a survey may have none.
    """
    store = Store(spark, shared_folder(spark, "store"))
    found = A.detections(spark, sf_dir).select("survey_id", "image_id", "detection_id", "class_confidence")
    fixes = A.navigation(spark, sf_dir).select("survey_id", "fix_id", "altitude_m")
    first = store.publish(detections=Change(found, ["survey_id"]), fixes=Change(fixes, ["survey_id"]))
    fifth, odd = found.where("survey_id % 5 = 0"), fixes.where("survey_id % 2 = 1")
    sure = fifth.where("class_confidence >= 0.5").withColumn("class_confidence", F.col("class_confidence") + 1)
    store.publish(detections=Change(sure, ["survey_id"], fifth), fixes=Change(odd.where("altitude_m > 20"), ["survey_id"], odd))
    out = None
    for table, value in (("detections", "class_confidence"), ("fixes", "altitude_m")):
        now = store.read(table).groupBy("survey_id").agg(F.count("*").alias("n"), F.round(F.sum(value), 3).alias("total"))
        rows = store.read(table, first).groupBy("survey_id").agg(F.count("*").alias("before")).join(now, "survey_id", "left")
        rows = rows.select(F.lit(table).alias("kind"), "survey_id", "before", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "total")
        out = rows if out is None else out.unionByName(rows)
    return out


def updated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a store after a partial update of the links of those at the left edge: nulls and other columns change nothing."""
    store = Store(spark, shared_folder(spark, "store"))
    found = A.detections(spark, sf_dir).select("survey_id", "detection_id", F.col("frame_index").alias("target_id"), "class_confidence", "x")
    store.publish(detections=Change(found, ["survey_id"]))
    links = found.where("x < 80").select("survey_id", "detection_id", F.when(F.col("x") < 48, F.col("target_id") + 1000).alias("target_id"))
    store.update("detections", links, ["survey_id", "detection_id"], ("target_id",))
    return store.read("detections").select("detection_id", "target_id", "class_confidence")


def evaluation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of three sets of images and of all, written as JSON documents and read back."""
    matches = E.greedy_match(*M.pairs(spark, sf_dir))
    sets = A.frames(spark, sf_dir).select("image_id", F.concat(F.lit("set_"), F.col("image_id") % 3).alias("manifest")).where("image_id % 7 != 0")
    path = shared_folder(spark, "metrics")
    write_documents(E.metrics_documents(matches, sets), path, "body")
    kinds = {"manifest": "string", "precision": "double", "recall": "double", "f1": "double", "false_alarms_per_image": "double"}
    return spark.read.schema(", ".join(f"{c} {kinds.get(c, 'long')}" for c in E.SET_FIELDS)).json(path)


def navigation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fixes, written as CSV files of two headers, as lines of GeoJSON and as CSV without an extension that tells so, and read back from one folder."""
    path = shared_folder(spark, "navigation")
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    fixes = A.navigation(spark, sf_dir).select("survey_id", when.alias("ts"), "lat", "lon", "heading_deg", "altitude_m", F.concat_ws(":", "survey_id", "fix_id").alias("source"))
    of = lambda k: fixes.where(F.col("survey_id") % 4 == k).drop("survey_id")
    of(0).withColumnsRenamed({"ts": "UTC", "lat": "Latitude", "lon": "lng", "altitude_m": "depth"}).write.csv(f"{path}/a", header=True)
    of(1).select("source", "altitude_m", "heading_deg", "lon", "lat", F.col("ts").alias("time")).write.option("extension", "txt").csv(f"{path}/b", header=True)
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry")
    props = F.struct(F.col("ts").alias("time"), F.col("heading_deg").alias("Heading"), F.col("altitude_m").alias("alt"), "source").alias("properties")
    of(2).select(F.lit("Feature").alias("type"), point, props).write.json(f"{path}/c")
    of(3).withColumnRenamed("ts", "iso_time").write.option("extension", "dat").csv(f"{path}/d", header=True)
    read = read_navigation_files(spark, path).where("position is not null")
    return read.select("source", "format", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "latitude", "longitude", "heading_deg", "altitude_m")


QUERIES = {f.__name__: f for f in (published_surveys, updated_links, evaluation_documents, navigation_files)}

ORACLES = {
    "navigation_files": f"""with {A.NAVIGATION} select survey_id || ':' || fix_id as source, case when survey_id % 4 = 2 then 'geojson' else 'csv' end as format, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts,
        lat as latitude, lon as longitude, heading_deg, altitude_m from navigation""",
    "published_surveys": f"""with {A.DETECTIONS}, {A.NAVIGATION},
        d as (select survey_id, count(*) as before, count(*) filter (survey_id % 5 <> 0 or class_confidence >= 0.5) as n,
            round(sum(class_confidence + (survey_id % 5 = 0)::int) filter (survey_id % 5 <> 0 or class_confidence >= 0.5), 3) as total from detections group by 1),
        f as (select survey_id, count(*) as before, count(*) filter (survey_id % 2 = 0 or altitude_m > 20) as n, round(sum(altitude_m) filter (survey_id % 2 = 0 or altitude_m > 20), 3) as total from navigation group by 1)
        select 'detections' as kind, * from d union all select 'fixes', * from f""",
    "updated_links": f"with {A.DETECTIONS} select detection_id, frame_index + case when x < 48 then 1000 else 0 end as target_id, class_confidence from detections",
    "evaluation_documents": f"""with {M.MATCHED}, parts as (select tp, n - tp as fp, truths - tp as fn, image_id from ends),
        own as (select 'set_' || o_orderkey % 3 as manifest, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn from orders left join parts on image_id = o_orderkey where o_orderkey % 7 <> 0),
        t as (select manifest, count(*) as images, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, count(*) filter (fp > 0) as images_with_false_alarms from own group by 1),
        r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as q from t)
        select manifest, images, tp + fn as gt_objects, tp, fp, fn, round(p, 4) as precision, round(q, 4) as recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 4) as f1, round(fp / images, 3) as false_alarms_per_image, images_with_false_alarms from r
        union all select null, null, null, sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint, null, null, null, null, null from parts""",
}
