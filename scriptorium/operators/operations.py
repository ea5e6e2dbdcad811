"""Running a corpus: what is left to do, shards, pages, progress, rates and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import format_span
from . import paging
from .numbering import numbered


def unprocessed(candidates: DataFrame, done: DataFrame, on: str | list[str]) -> DataFrame:
    """Candidates whose key is not among the done; repeated candidates stay."""
    return candidates.join(done.select(*([on] if isinstance(on, str) else on)), on, "left_anti")


def processed(candidates: DataFrame, done: DataFrame, on: str | list[str]) -> DataFrame:
    return candidates.join(done.select(*([on] if isinstance(on, str) else on)), on, "left_semi")


def to_do(candidates: DataFrame, done: DataFrame, on: str, limit: int | None = None, force: bool = False) -> DataFrame:
    """The first ``limit`` candidates by key, and of these what is not done (all of them with ``force``)."""
    first = candidates.orderBy(on).limit(limit) if limit is not None else candidates
    return first if force else unprocessed(first, done, on)


def page(df: DataFrame, order: str | list[str], start: int, size: int) -> DataFrame:
    """``size`` rows from place ``start`` on, in the given order: of stored ranges, so that no task or driver has what is before the page.

    For many pages of one table keep what :func:`.paging.ordered` stores.
    """
    return paging.page(paging.ordered(df, order), start, size)


def global_places(df: DataFrame, order: str) -> DataFrame:
    """Adds ``place``, from 0 by ``order`` (a column of any type, nulls first), without sorting everything in one task.

    Object keys are strings, and their places are found like numbers': by ranges of the key, see :func:`numbered`. Rows with
    equal keys have places next to one another.
    """
    return numbered(df, [F.col(order)])[0].withColumnRenamed("row_number", "place")


def modulo_shard(df: DataFrame, order: str, worker: int, workers: int) -> DataFrame:
    """The rows whose place by ``order`` leaves ``worker`` by ``workers``."""
    return global_places(df, order).where(F.col("place") % workers == worker).drop("place")


def latest(objects: DataFrame, time_col: str = "modificationTime", key_col: str = "path") -> DataFrame:
    """The newest object; of equals, the greatest key."""
    return objects.agg(F.max_by(key_col, F.struct(time_col, key_col)).alias(key_col), F.max(time_col).alias(time_col))


def hourly(objects: DataFrame, now: Column, time_col: str = "modificationTime", hours: int = 24) -> DataFrame:
    """(hour, files): counts by hour of objects later than ``hours`` before ``now``."""
    recent = objects.where(F.col(time_col) > now - F.make_dt_interval(hours=F.lit(hours)))
    return recent.groupBy(F.date_format(time_col, "yyyy-MM-dd HH:00").alias("hour")).agg(F.count("*").alias("files"))


def newest_hours(by_hour: DataFrame, hours: int = 12) -> DataFrame:
    return by_hour.orderBy(F.desc("hour")).limit(hours)


def recent_rate(by_hour: DataFrame, hours: int = 3, files_per_item: float = 35.0) -> DataFrame:
    """(files_per_hour, items_per_hour) of the newest hours that have files; null without any."""
    rate = F.avg("files")
    return newest_hours(by_hour, hours).agg(rate.alias("files_per_hour"), (rate / files_per_item).alias("items_per_hour"))


def status(total: int, done: int, by_hour: DataFrame, objects: DataFrame, now: Column, time_col: str = "modificationTime") -> DataFrame:
    """One row: counts, percent (null without items), last upload and its age, rate, and hours left (null without a rate)."""
    last = objects.agg(F.max(time_col).alias("last_upload"))
    joined = recent_rate(by_hour).crossJoin(F.broadcast(last))  # two rows of one
    age = F.unix_timestamp(now) - F.unix_timestamp("last_upload")
    return joined.select(
        F.lit(total).alias("total"), F.lit(done).alias("processed"), F.floor(F.try_divide(F.lit(done) * 100, F.lit(total))).alias("percent"), F.lit(total - done).alias("remaining"),
        "last_upload", format_span(age).alias("age"), (age <= 3600).alias("active"), "items_per_hour", F.try_divide(F.lit(float(total - done)), F.col("items_per_hour")).alias("hours_left"),
    )


#: What to look at when nothing has been uploaded for an hour.
IDLE_ADVICE = [
    "No uploads in the last hour. Look at the running job's stages and at the failures table,",
    "check that executors are alive and have disk and memory left,",
    "and start the job again: documents that are done are left out.",
]


def run_counters(outcomes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of outcome rows (id, status in ok, skipped, failed, no_url): found, each status, and the success rate in percent (0 without rows)."""
    n = lambda s: F.count_if(F.col("status") == s)
    good = n("ok") + n("skipped")
    aggregates = [
        F.count("*").alias("found"), n("ok").alias("downloaded"), n("skipped").alias("skipped"), n("failed").alias("failed"), n("no_url").alias("no_url"),
        F.coalesce(F.try_divide(good * 100.0, F.count("*")), F.lit(0.0)).alias("success_rate"),
    ]
    return outcomes.groupBy(*by).agg(*aggregates) if by else outcomes.agg(*aggregates)


def first_failures(outcomes: DataFrame, most: int = 10) -> DataFrame:
    return outcomes.where("status = 'failed'").select("id").orderBy("id").limit(most)


def duration_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds from start to end, or to now where there is no end."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.coalesce(c(end).cast("timestamp"), F.current_timestamp()).cast("double") - c(start).cast("timestamp").cast("double")
