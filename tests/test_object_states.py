"""The stream of object states in two halves, with a restart, against grouping all events."""

import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.streaming import incremental, objects

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "object string, outcome string, time timestamp"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def halves():
    """Done, retried and done, failed for good, still waiting, silent; repeated events, and late ones on either side of the watermark."""
    first = [(f"o{i}", "listed", at(i)) for i in range(30)]
    first += [(f"o{i}", "done", at(40 + i)) for i in range(8)]
    first += [(f"o{i}", "failed", at(60 + i)) for i in range(8, 14)] + [("o8", "failed", at(68)), ("o9", "failed", at(70))]
    first += [("o1", "done", at(41)), (None, "done", at(5)), ("o2", "done", None)]
    second = [(f"o{i}", "failed", at(100 + i)) for i in range(8, 12)] + [(f"o{i}", "failed", at(140 + i)) for i in range(8, 10)]
    second += [("o8", "failed", at(68)), ("o12", "done", at(150)), ("o10", "done", at(151)), ("o14", "listed", at(90)), ("o20", "done", at(160))]
    second += [("new", "listed", at(155))]
    return first, second


def run(spark, source, out, checkpoint, **rules):
    stream = incremental.stream_table(spark, source, SCHEMA, files_per_trigger=1)
    query = objects.write_changes(stream, out, checkpoint, **rules)
    query.awaitTermination()


def rows(df):
    return sorted((r["object"], r["status"], r["failures"], r["last"]) for r in df.collect())


def test_two_halves_and_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("events", "changes", "checkpoint"))
    first, second = halves()
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(source)
    run(spark, source, out, checkpoint)
    got = objects.current(spark.read.parquet(out))
    assert rows(got) == rows(objects.states_of(spark.createDataFrame(first, SCHEMA)))
    before = spark.read.parquet(out).count()
    run(spark, source, out, checkpoint)  # nothing new: a restart changes nothing
    assert spark.read.parquet(out).count() == before
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, checkpoint)  # a new query that goes on from the first one's state
    got = objects.current(spark.read.parquet(out))
    want = objects.states_of(spark.createDataFrame(first + second, SCHEMA))
    assert rows(got) == rows(want)
    status = {r["object"]: (r["status"], r["failures"]) for r in got.collect()}
    assert (status["o8"], status["o9"], status["o10"], status["o11"], status["o12"], status["o29"]) == (("failed", 3), ("failed", 4), ("done", 2), ("retry", 2), ("done", 1), ("waiting", 0))
    changes = spark.read.parquet(out)
    assert changes.groupBy("object", "version").count().where("count > 1").count() == 0  # each change once


def test_stale_by_timer_and_too_late(spark, tmp_path):
    """The watermark passes some objects' last event: they are stale until heard of again; what comes too late is dropped."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("events", "changes", "checkpoint"))
    rules = {"stale": datetime.timedelta(hours=2), "late": "10 minutes"}
    parts = [
        [("silent", "listed", at(0)), ("back", "failed", at(5)), ("busy", "listed", at(10))],
        [("busy", "failed", at(200))],
        [("busy", "failed", at(210)), ("silent", "done", at(100))],  # this one is older than the watermark
        [("back", "done", at(220)), ("other", "listed", at(230))],
    ]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, out, checkpoint, **rules)
    got = {r["object"]: (r["status"], r["failures"]) for r in objects.current(spark.read.parquet(out)).collect()}
    assert got == {"silent": ("stale", 0), "back": ("done", 1), "busy": ("retry", 2), "other": ("waiting", 0)}
    seen = {(r["object"], r["status"]) for r in spark.read.parquet(out).collect()}
    assert ("back", "stale") in seen and ("back", "retry") in seen


def test_progress(spark):
    states = spark.createDataFrame([(f"d{i}", "done", 0, at(60 * i)) for i in range(10)] + [("w", "waiting", 0, at(0)), ("r", "retry", 1, at(0)), ("s", "stale", 0, at(0)), ("f", "failed", 3, at(0))], "object string, status string, failures int, last timestamp")
    row = objects.progress(states, hours=3).first()
    assert (row["objects"], row["done"], row["waiting"], row["retry"], row["stale"], row["failed"]) == (14, 10, 1, 1, 1, 1)
    assert row["done_per_hour"] == 1.0 and row["hours_left"] == 3.0
    empty = objects.progress(states.limit(0)).first()
    assert empty["objects"] == 0 and empty["hours_left"] is None


@pytest.mark.parametrize("now", [None, at(1000)])
def test_states_of_repeated_events(spark, now):
    events = spark.createDataFrame([("a", "failed", at(1)), ("a", "failed", at(1)), ("b", None, at(1))], SCHEMA)
    got = {r["object"]: (r["status"], r["failures"]) for r in objects.states_of(events, retries=1, now=now).collect()}
    assert got == ({"a": ("retry", 1), "b": ("waiting", 0)} if now is None else {"a": ("stale", 1), "b": ("stale", 0)})
    assert objects.states_of(events.where(F.lit(False))).count() == 0
