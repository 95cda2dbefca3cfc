"""Streaming forms: navigation sessions with a watermark, and jobs over micro-batches with their events and the states of their frames."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from threading import Condition

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from deepledger.operators.navigation import sessions, validated

#: Events that a job keeps until they are read; older ones go first. Seconds between looks for new ones.
EVENTS, POLL_S = 1000, 0.35
ENDED = ("done", "failed")
STATES = "image_id long, status string, job string, batch long, at long"


def session_stream(fixes: DataFrame, late: str = "10 minutes", gap: str = "60 seconds") -> DataFrame:
    """Finished sessions of valid fixes (survey_id, ts, …): a gap ends one, and fixes later than the watermark are dropped."""
    valid = validated(fixes).where("reject_reason is null and ts is not null")
    return sessions(valid.withWatermark("ts", late), gap)


class JobEvents(StreamingQueryListener):
    """The events of one streaming query, by its name: queued, running at its start and after each batch, then done or failed.

    rows is Spark's count of a batch, which has a row once for each time that the batch is read.

    Spark calls the listener from its own thread; readers drain the queue from theirs.
    """

    def __init__(self, job: str, limit: int = EVENTS):
        self.job, self.status, self.reason, self._id = job, "queued", None, None
        self._queue: deque[dict] = deque(maxlen=limit)
        self._changed = Condition()
        self._emit("queued")

    def _emit(self, status: str, batch: int | None = None, rows: int | None = None, message: str | None = None) -> None:
        with self._changed:
            self.status = status
            self._queue.append({"job": self.job, "status": status, "batch": batch, "rows": rows, "message": message})
            self._changed.notify_all()

    def onQueryStarted(self, event) -> None:
        if event.name == self.job:
            self._id = event.runId
            self._emit("running")

    def onQueryProgress(self, event) -> None:
        if event.progress.runId == self._id:
            self._emit("running", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self._id:
            self._emit("failed" if event.exception else "done", message=event.exception and (self.reason or event.exception)[:500])

    def settle(self, seconds: float = 30.0) -> None:
        """Waits until Spark has told that the query ended, which it does a little after the end itself."""
        with self._changed:
            self._changed.wait_for(lambda: self.status in ENDED, seconds)

    def drain(self) -> list[dict]:
        """The events since the last call."""
        with self._changed:
            out = list(self._queue)
            self._queue.clear()
        return out

    def follow(self, poll: float = POLL_S) -> Iterator[dict]:
        """Events as they come, until the job has ended and none is left."""
        while True:
            with self._changed:
                if not self._queue and self.status not in ENDED:
                    self._changed.wait(poll)
                ended = self.status in ENDED
            events = self.drain()
            yield from events
            if ended and not events:
                return


def _log(frames: DataFrame, states: str, status: str, job: str, batch: int | None) -> None:
    rows = frames.select(F.col("image_id").cast("long").alias("image_id"), F.lit(status).alias("status"), F.lit(job).alias("job"), F.lit(batch).cast("long").alias("batch"), F.lit(time.time_ns()).alias("at"))
    rows.where("image_id is not null").distinct().write.mode("append").parquet(states)


def frame_states(spark: SparkSession, states: str) -> DataFrame:
    """(image_id, status, job, batch): the last state of each frame in a job's log. No log: no rows."""
    try:
        rows = spark.read.schema(STATES).parquet(states)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STATES)
    return rows.groupBy("image_id").agg(F.max_by(F.struct("status", "job", "batch"), "at").alias("last")).select("image_id", "last.*")


def run_job(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, name: str, states: str | None = None, events: JobEvents | None = None) -> JobEvents:
    """Runs handle on each micro-batch of what is there and returns the job's events; raises what ended it, after the events and states are set.

    events: a listener of that name, given by a caller who follows it from another thread or reads it after a failure.

    states: a folder that gets the states of the frames, by the stream's image_id: analyzing before a batch is handled, analyzed
    after it. If the job fails, frames that it leaves analyzing become failed; a run with the same checkpoint takes them up again.
    handle must bear being called twice with the same batch, as after a lost driver.
    """
    spark, events = stream.sparkSession, events or JobEvents(name)

    def one(batch: DataFrame, number: int) -> None:
        if states:
            _log(batch, states, "analyzing", name, number)
        try:
            handle(batch, number)
        except Exception as error:  # Spark's own text begins with the stack
            events.reason = f"{type(error).__name__}: {error}"
            raise
        if states:
            _log(batch, states, "analyzed", name, number)

    spark.streams.addListener(events)
    try:
        query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            if states:
                _log(frame_states(spark, states).where((F.col("job") == name) & (F.col("status") == "analyzing")), states, "failed", name, None)
            raise
        finally:
            events.settle()
    finally:
        spark.streams.removeListener(events)
    return events
