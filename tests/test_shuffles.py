"""How often rows are shuffled, and how many of them a task holds."""

import re

from pyspark.sql import functions as F

from deepledger.llm import chat
from deepledger.operators import evaluation as E
from deepledger.operators import location as L
from deepledger.operators import reporting as R
from deepledger.plans import survey_queries
from deepledger.sources import adapters as A
from deepledger.sources.store import Change, Store, shared_folder
from tests.oracle import SF


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_pairs_of_a_snapshot_are_ranked_where_they_met(spark):
    d = A.detections(spark, SF).select("survey_id", "frame_index", "detection_id", "class_name", "lat", "lon", *"xywh").localCheckpoint()
    assert exchanges(L.snapshot_candidates(d)) <= 2


def test_report_reads_detections_once(spark):
    d = A.detections(spark, SF).localCheckpoint()
    assert exchanges(R.markdown_lines(d)) == 1


def longest_method(spark, df):
    """Bytes of the longest method that is generated for the plan; the JVM compiles none of more than 8,000."""
    debug = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else stages are compiled only while they run
    try:
        made = debug.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size()))


def test_located_rows_come_from_methods_that_are_compiled(spark):
    rows = A.detections(spark, SF).drop("survey_id", "frame_index").join(A.frames(spark, SF), "image_id").localCheckpoint()
    r = L.located(rows, A.IMAGE_HEIGHT)
    assert longest_method(spark, r.select("detection_id", "location_status", "det_lat", "det_lon")) <= 8000


def test_features_come_from_methods_that_are_compiled(spark):
    assert longest_method(spark, survey_queries.geojson_report(spark, SF)) <= 8000


def test_ellipses_are_drawn_where_their_rows_are_read(spark):
    rows = spark.createDataFrame([(i, 50.0, 10.0, 90.0, "port", None) for i in range(5)] + [(9, None, 1.0, 90.0, "port", 1.0), (8, 50.0, 1.0, None, "port", 1.0)], "id long, slant_m double, effective_m double, ok_heading double, ok_side string, accuracy_m double")
    made = L.uncertainty(rows, "id")
    assert exchanges(made) == 0 and "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r for r in made.collect()}
    assert len({tuple(r)[1:] for i, r in got.items() if i < 5}) == 1 and got[9]["radius_m"] is not None and got[8]["radius_m"] is None


def test_flat_report_shuffles_rows_and_not_detections(spark):
    made = survey_queries.csv_report(spark, SF)
    assert longest_method(spark, made) <= 8000
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert "concat_ws" in plan and "concat_ws" not in plan.split("Exchange hashpartitioning")[1]


def test_first_publication_reads_its_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: reads.add(1) or x, "long")
    rows = spark.range(50).select(seen(F.col("id")).alias("survey_id"))
    store = Store(spark, shared_folder(spark, "store"))
    store.publish(t=Change(rows, ["survey_id"]))
    assert store.read("t").count() == 50 and reads.value == 50


def test_update_reads_its_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: reads.add(1) or x, "long")
    store = Store(spark, shared_folder(spark, "store"))
    store.publish(t=Change(spark.range(50).select(F.col("id").alias("survey_id"), F.lit(1).alias("v")), ["survey_id"]))
    store.update("t", spark.range(10).select(F.col("id").alias("survey_id"), seen(F.col("id")).cast("int").alias("v")), ["survey_id"], ("v",))
    assert reads.value == 10 and store.read("t").agg(F.sum("v")).first()[0] == 45 + 40


def test_unmatched_images_meet_in_as_many_partitions_as_their_rows_ask_for(spark, monkeypatch):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "image_id long")
    frames, labels = ids(1, 2, 2, 3, None), ids(3, 4, 4, None)
    want = [(None, "no frame"), (None, "no label"), (1, "no label"), (2, "no label"), (2, "no label"), (4, "no frame")]
    assert sorted(map(tuple, E.unmatched(frames, labels).collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(E, "ROWS_A_TASK", 1)
    assert E.unmatched(frames, labels).rdd.getNumPartitions() == 9


def test_read_back_holds_a_slice_of_conversations(spark, monkeypatch):
    import pyarrow as pa

    made = []
    monkeypatch.setattr(chat, "parse", lambda text: made.append(text) or [])
    chats = spark.createDataFrame([], chat.SCHEMA)
    work = []
    monkeypatch.setattr(type(chats), "mapInArrow", lambda self, f, schema: work.append(f))
    chat.read_back(chats)
    n = 2 * chat.SLICE + 1
    rows = pa.table({"conv_id": range(n), "formatted": [""] * n, **{c: pa.array([[]] * n, pa.list_(pa.int32())) for c in ("input_ids", "starts", "ends", "loss_mask")}}).to_batches()[0]
    sizes = [b.num_rows for b in work[0]([rows])]
    assert sizes == [chat.SLICE, chat.SLICE, 1] and len(made) == n
