"""Jobs over micro-batches: the order of their events, failures, and the states of their frames."""

from threading import Thread

import pytest

from deepledger.streaming import jobs


@pytest.fixture
def frames(spark, tmp_path):
    for part in range(3):  # a file, and so a batch, each
        spark.createDataFrame([(part * 10 + i,) for i in range(4)] + [(part * 10,), (None,)], "image_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("image_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def states(spark, path):
    return {r["image_id"]: r["status"] for r in jobs.frame_states(spark, path).collect()}


def test_events_and_states_of_a_whole_job(spark, frames, tmp_path):
    log, events, heard = str(tmp_path / "states"), jobs.JobEvents("whole"), []
    assert states(spark, log) == {}
    reader = Thread(target=lambda: heard.extend(events.follow()))
    reader.start()
    jobs.run_job(frames, lambda b, n: None, str(tmp_path / "c"), "whole", log, events)
    reader.join(30)
    assert not reader.is_alive() and [e["status"] for e in heard[:2]] == ["queued", "running"] and heard[-1]["status"] == "done"
    assert [e["batch"] for e in heard if e["rows"]] == [0, 1, 2]
    assert states(spark, log) == {p * 10 + i: "analyzed" for p in range(3) for i in range(4)}


def test_a_failing_batch_marks_its_frames_and_can_be_taken_up(spark, frames, tmp_path):
    log, checkpoint, events, done = str(tmp_path / "states"), str(tmp_path / "c"), jobs.JobEvents("broken"), []

    def handle(batch, number):
        if number == 1 and not done:
            raise ValueError("no model")

    with pytest.raises(Exception, match="no model"):
        jobs.run_job(frames, handle, checkpoint, "broken", log, events)
    heard = list(events.follow())
    assert [e["status"] for e in heard[:2]] == ["queued", "running"] and heard[-1]["status"] == "failed" and "no model" in heard[-1]["message"]
    assert [e["batch"] for e in heard if e["rows"]] == [0]
    found = states(spark, log)
    assert sorted(found.values()) == ["analyzed"] * 4 + ["failed"] * 4  # the third batch was never begun
    done.append(True)
    again = list(jobs.run_job(frames, handle, checkpoint, "broken", log).follow())
    assert again[-1]["status"] == "done" and [e["batch"] for e in again if e["rows"]] == [1, 2]
    assert set(states(spark, log).values()) == {"analyzed"} and len(states(spark, log)) == 12


def test_the_queue_is_bounded(spark):
    events = jobs.JobEvents("many", limit=5)
    for i in range(20):
        events._emit("running", i)
    assert [e["batch"] for e in events.drain()] == [15, 16, 17, 18, 19] and events.drain() == []
