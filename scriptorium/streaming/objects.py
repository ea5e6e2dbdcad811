"""The state of every object of a running job, kept by a stream: waiting, to be retried, done, failed or stale.

Events (object, outcome, time) say that an object was listed, done or failed. The stream keeps a state for each object with timers on event time, in the
state store, so it goes on after a restart where it was. What it writes are changes, a row whenever an object's status, count of failures or last time changes;
:func:`current` gives the last of each object, and rates and the time left come from these.

A state doesn't depend on the order in which events come, and repeated events change nothing: an object is done if any event says so, else it
has as many failures as there are distinct times of failures. Events later than the watermark are dropped.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state store that timers and several states of a key need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGES = "object string, status string, failures int, version long, last_ms long"
FINISHED = ("done", "failed")


def status_of(done: bool, failures: int, retries: int, idle: bool) -> str:
    """done, else failed after more failures than ``retries``, else stale if nothing was heard for too long, else retry or waiting."""
    if done:
        return "done"
    if failures > retries:
        return "failed"
    return "stale" if idle else "retry" if failures else "waiting"


EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def _ms(time: datetime.datetime) -> int:
    """Whole milliseconds, as Spark cuts them."""
    return (time.astimezone(datetime.timezone.utc) - EPOCH) // datetime.timedelta(milliseconds=1)


class ObjectStates(StatefulProcessor):
    """Folds an object's events and sets a timer for when it will be stale; a later event makes it fresh again."""

    def __init__(self, retries: int, stale_ms: int):
        self.retries, self.stale_ms = retries, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("object", "done boolean, status string, failures int, version long, last_ms long")
        self.failed_at = handle.getMapState("failed", "at long", "times long")

    def _change(self, key, done: bool, status: str, failures: int, version: int, last: int, before: tuple) -> Iterator[Row]:
        changed = (status, failures, last) != before
        self.state.update((done, status, failures, version + changed, last))
        if changed:
            yield Row(object=key[0], status=status, failures=failures, version=version + 1, last_ms=last)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, status, failures, version, last = self.state.get() if self.state.exists() else (False, None, 0, 0, 0)
        before, previous = (status, failures, last), last
        for row in rows:
            at = _ms(row["time"])
            last, done = max(last, at), done or row["outcome"] == "done"
            if row["outcome"] == "failed" and not self.failed_at.containsKey((at,)):
                self.failed_at.updateValue((at,), (1,))
                failures += 1
        now = timerValues.getCurrentWatermarkInMs()
        status = status_of(done, failures, self.retries, now >= last + self.stale_ms)
        if previous and previous + self.stale_ms > now:
            self.handle.deleteTimer(previous + self.stale_ms)
        if status not in FINISHED and status != "stale":
            self.handle.registerTimer(last + self.stale_ms)
        yield from self._change(key, done, status, failures, version, last, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        done, status, failures, version, last = self.state.get()
        idle = timerValues.getCurrentWatermarkInMs() >= last + self.stale_ms
        yield from self._change(key, done, status_of(done, failures, self.retries, idle), failures, version, last, (status, failures, last))

    def close(self) -> None:
        pass


def object_changes(events: DataFrame, retries: int = 2, stale: datetime.timedelta = datetime.timedelta(hours=6), late: str = "1 hour") -> DataFrame:
    """A stream of changes (CHANGES) of a stream of events (object, outcome in listed, done, failed; time). Rows without object or time are left out.

    An object fails after more than ``retries`` failures, and is stale when the watermark is ``stale`` after its last event and it is neither done nor failed.
    """
    named = events.where("object IS NOT NULL AND time IS NOT NULL").select("object", "outcome", "time").withWatermark("time", late)
    processor = ObjectStates(retries, round(stale.total_seconds() * 1000))
    return named.groupBy("object").transformWithState(statefulProcessor=processor, outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def write_changes(events: DataFrame, path: str, checkpoint: str, available_now: bool = True, **rules) -> StreamingQuery:
    """Appends the changes of a stream of events to Parquet files, exactly once; goes on from ``checkpoint``."""
    events.sparkSession.conf.set(*STORE)
    writer = object_changes(events, **rules).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(changes: DataFrame) -> DataFrame:
    """The last change of each object, with ``last`` as a time: one partial maximum for each object and task."""
    newest = changes.groupBy("object").agg(F.max_by(F.struct("status", "failures", "last_ms"), "version").alias("s"))
    return newest.select("object", "s.status", "s.failures", F.timestamp_millis("s.last_ms").alias("last"))


def states_of(events: DataFrame, retries: int = 2, stale: datetime.timedelta = datetime.timedelta(hours=6), now: datetime.datetime | None = None) -> DataFrame:
    """What :func:`current` has after all events, by grouping them: (object, status, failures, last). Without ``now`` nothing is stale."""
    done, failures = F.max(F.coalesce(F.col("outcome") == "done", F.lit(False))), F.count_distinct(F.when(F.col("outcome") == "failed", F.unix_millis("time")))
    grouped = events.where("object IS NOT NULL AND time IS NOT NULL").groupBy("object").agg(done.alias("done"), failures.cast("int").alias("failures"), F.max("time").alias("last"))
    idle = F.lit(False) if now is None else F.unix_millis("last") + round(stale.total_seconds() * 1000) <= _ms(now)
    status = F.when(F.col("done"), "done").when(F.col("failures") > retries, "failed").when(idle, "stale").when(F.col("failures") > 0, "retry").otherwise("waiting")
    return grouped.select("object", status.alias("status"), "failures", F.timestamp_millis(F.unix_millis("last")).alias("last"))


def progress(states: DataFrame, hours: int = 3) -> DataFrame:
    """One row: objects by status, how many were done in an hour of the last ``hours`` before the newest done one, and the hours left at that rate (null without a rate)."""
    last_done = F.when(F.col("status") == "done", F.col("last"))
    newest = states.agg(F.max(last_done).alias("newest"))
    counted = states.crossJoin(F.broadcast(newest))  # one row
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    recent = F.count_if((F.col("status") == "done") & (F.col("last") > F.col("newest") - F.make_dt_interval(hours=F.lit(hours))))
    open_ = F.count_if(~F.col("status").isin(*FINISHED))
    rate = (recent / hours).alias("done_per_hour")
    return counted.agg(F.count("*").alias("objects"), *[n(s) for s in ("waiting", "retry", "done", "failed", "stale")], rate, F.try_divide(open_.cast("double"), recent / hours).alias("hours_left"))
