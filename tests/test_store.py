"""Publications are visible as a whole or not at all."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from deepledger.sources.store import Change, Conflict, Manifest, Store

FIXES = "survey_id long, fix_id long, lat double"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), buckets=4)
    first = [(s_, f, s_ + f / 10) for s_ in range(8) for f in range(3)]
    assert s.publish(fixes=Change(spark.createDataFrame(first, FIXES), ["survey_id"])) == 1
    return s


def test_replaces_a_survey_and_leaves_others(spark, store):
    before = dict(store.manifest().folders["fixes"])
    new = spark.createDataFrame([(3, 9, 1.5)], FIXES)
    assert store.publish(fixes=Change(new, ["survey_id"])) == 2
    assert rows(store.read("fixes").where("survey_id = 3"), "fix_id") == [(3, 9, 1.5)]
    assert store.read("fixes").count() == 22
    assert store.read("fixes", version=1).count() == 24
    after = store.manifest().folders["fixes"]
    assert sum(before[b] != after.get(b) for b in before) == 1  # one bucket was rewritten


def test_a_survey_may_become_empty(spark, store):
    gone = spark.createDataFrame([(s,) for s in range(8)], "survey_id long")
    store.publish(fixes=Change(spark.createDataFrame([], FIXES), ["survey_id"], replaced=gone))
    assert store.read("fixes").count() == 0 and store.read("fixes").columns == ["survey_id", "fix_id", "lat"]
    store.publish(fixes=Change(spark.createDataFrame([(None, 1, None)], FIXES), ["survey_id"]))
    store.publish(fixes=Change(spark.createDataFrame([(None, 2, None)], FIXES), ["survey_id"]))
    assert rows(store.read("fixes"), "fix_id") == [(None, 2, None)]


def test_replaces_the_rows_of_a_frame(spark, store):
    found = "survey_id long, image_id long, detection_id string"
    store.publish(found=Change(spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c")], found), ["survey_id", "image_id"]))
    store.publish(found=Change(spark.createDataFrame([(1, 1, "d")], found), ["survey_id", "image_id"]))
    assert [r[2] for r in rows(store.read("found"), "detection_id")] == ["c", "d"]


def test_a_failing_task_changes_nothing(spark, store):
    before = rows(store.read("fixes"), "survey_id", "fix_id")
    good = Change(spark.createDataFrame([(1, 7, 0.0)], FIXES), ["survey_id"])
    torn = spark.range(8).select((F.col("id") % 8).alias("survey_id"), F.col("id").alias("fix_id"), F.when(F.col("id") == 5, F.raise_error(F.lit("torn")).cast("double")).otherwise(1.0).alias("lat"))
    with pytest.raises(PySparkException):
        store.publish(other=good, fixes=Change(torn, ["survey_id"]))
    assert store.manifest().version == 1 and store.read("other") is None
    assert rows(store.read("fixes"), "survey_id", "fix_id") == before
    assert len(store.clean()) == 1  # what the failed one had staged
    assert rows(store.read("fixes"), "survey_id", "fix_id") == before


def test_a_torn_manifest_is_passed_over(spark, store):
    store.publish(fixes=Change(spark.createDataFrame([(0, 0, 9.0)], FIXES), ["survey_id"]))
    path = f"{store.path}/versions/{3:012d}.json"
    text = store.manifest().text()
    with open(path, "w") as f:
        f.write(text[: len(text) // 2])
    assert Manifest.of(text[:-3]) is None
    assert store.manifest().version == 2
    assert store.publish(fixes=Change(spark.createDataFrame([(0, 1, 8.0)], FIXES), ["survey_id"])) == 4
    assert rows(store.read("fixes").where("survey_id = 0"), "fix_id") == [(0, 1, 8.0)]


def test_of_two_writers_one_wins(spark, store, monkeypatch):
    stage = Store._stage

    def slow(self, *args):
        stage(self, *args)
        monkeypatch.setattr(Store, "_stage", stage)
        Store(spark, store.path).publish(fixes=Change(spark.createDataFrame([(2, 1, 1.0)], FIXES), ["survey_id"]))

    monkeypatch.setattr(Store, "_stage", slow)
    with pytest.raises(Conflict):
        store.publish(fixes=Change(spark.createDataFrame([(2, 2, 2.0)], FIXES), ["survey_id"]))
    assert rows(store.read("fixes").where("survey_id = 2"), "fix_id") == [(2, 1, 1.0)]


def test_partial_update_takes_listed_columns_and_no_nulls(spark, store):
    kind = "survey_id long, target_id string, lat double, status string"
    store.publish(targets=Change(spark.createDataFrame([(1, "t", 5.0, "old"), (2, "u", 6.0, "old")], kind), ["survey_id", "target_id"]))
    new = spark.createDataFrame([(1, "t", None, "new"), (9, "x", 1.0, "new")], kind)
    store.update("targets", new, ["survey_id", "target_id"], ("lat", "status"))
    assert rows(store.read("targets"), "survey_id") == [(1, "t", 5.0, "new"), (2, "u", 6.0, "old")]
    with pytest.raises(ValueError):
        store.update("targets", new, ["survey_id", "target_id"], ("lat",))


def test_reports_are_registered_with_their_size(spark, store):
    report = store.write_report(spark.createDataFrame([("# Survey",), ("- 3 fixes",)], "value string").coalesce(1), "7", "text")
    row = store.read("reports").first()
    assert (row["report_id"], row["survey_id"], row["format"]) == (report, "7", "text")
    files = [os.path.join(row["path"], f) for f in os.listdir(row["path"]) if f.startswith("part-")]
    assert "".join(open(f).read() for f in files) == "# Survey\n- 3 fixes\n"
    assert row["size_bytes"] == len("# Survey\n- 3 fixes\n")
    with pytest.raises(PySparkException):
        store.write_report(spark.range(1).select(F.raise_error(F.lit("no")).alias("value")), "7", "text")
    assert store.read("reports").count() == 1


def test_refuses_unlike_columns_and_keys_without_survey(spark, store):
    with pytest.raises(ValueError):
        store.publish(fixes=Change(spark.createDataFrame([(1, 2)], "survey_id long, fix_id long"), ["survey_id"]))
    with pytest.raises(ValueError):
        store.publish(fixes=Change(spark.createDataFrame([(1, 2, 3.0)], FIXES), ["fix_id"]))
    with pytest.raises(KeyError):
        store.read("fixes", version=7)
