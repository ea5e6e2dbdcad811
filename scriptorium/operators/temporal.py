"""Joins on order: overlapping intervals, and the last row at or before a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import stored

#: An interval meets FAN + 1 bins of its level at most; each level's bins are FAN times as wide as those of the level below. LONGEST is the longest interval.
FAN, LONGEST = 8, 1 << 60
#: Parts that a bin of a higher level is split into.
PARTS = 64


def _levelled(df: DataFrame, side: str, on: list[str], span: tuple[str, str], width: int) -> DataFrame:
    """Rows packed as ``side`` with keys, integer bounds and the level by length; empty and unbounded intervals meet nothing."""
    start, stop = F.col(span[0]).cast("long"), F.col(span[1]).cast("long")
    packed = df.select(F.struct(*df.columns).alias(side), *[F.col(c).alias(f"k{i}") for i, c in enumerate(on)], start.alias("start"), stop.alias("stop")).where("stop > start")
    lengths = takewhile(lambda n: n < LONGEST, (width * FAN**n for n in count(1)))
    return packed.withColumn("level", F.size(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n < F.col("stop") - F.col("start"))))


def _present(df: DataFrame) -> list[int]:
    return sorted(r["level"] for r in df.select("level").distinct().collect())  # a few


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 256) -> DataFrame:
    """Pairs of rows with equal keys ``on`` whose half-open integer intervals overlap: columns ``l`` and ``r``, structs of the whole rows.

    Bins of ``width`` are the lowest of several levels, each FAN times as wide as the one below. An interval belongs to the level where it meets few
    bins, so a very long one has few rows too. Pairs meet on the higher of their levels: there the longer one is in the bins it meets, and shorter
    ones are in theirs, one or two. Of the bins that a pair has in common the first counts. A long key is split by its bins, and a wide bin
    into parts, over which the shorter rows are dealt while the longer ones are in all. Null keys and bounds and empty intervals join with
    nothing; repeated rows give repeated pairs; columns may have any names.
    """
    a, b = _levelled(left, "l", on, left_span, width), _levelled(right, "r", on, right_span, width)
    keys = [f"k{i}" for i in range(len(on))]
    wide = lambda: F.pow(F.lit(FAN), F.col("at")).cast("long") * width
    parts = lambda: F.least(F.lit(PARTS), F.pow(F.lit(FAN), F.col("at"))).cast("int")
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / wide()), F.floor((F.col("stop") - 1) / wide())))

    def longer(df: DataFrame, side: str) -> DataFrame:
        """In the bins of its own level, in every part of them."""
        own = df.withColumn("at", F.col("level")).withColumn("bin", bins()).withColumn("part", F.explode(F.sequence(F.lit(0), parts() - 1)))
        return own.select(*keys, "at", "bin", "part", side, F.col("start").alias(f"start_{side}"), F.col("stop").alias(f"stop_{side}"))

    def shorter(df: DataFrame, side: str, levels: list[int], same: bool) -> DataFrame:
        """In the bins of the other side's levels above its own, or ``same`` as its own, each in one part."""
        above = F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n >= F.col("level") if same else n > F.col("level"))
        spread = df.withColumn("at", F.explode(above)).withColumn("bin", bins())
        return spread.select(*keys, "at", "bin", F.pmod(F.xxhash64("start", "stop", side), parts()).cast("int").alias("part"), side, F.col("start").alias(f"start_{side}"), F.col("stop").alias(f"stop_{side}"))

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        first = F.floor(F.greatest("start_l", "start_r") / wide())
        meet = (F.col("start_l") < F.col("stop_r")) & (F.col("start_r") < F.col("stop_l")) & (F.col("bin") == first)
        return x.join(y, [*keys, "at", "bin", "part"]).where(meet).select("l", "r")

    return joined(longer(a, "l"), shorter(b, "r", _present(a), True)).unionByName(joined(shorter(a, "l", _present(b), False), longer(b, "r")))


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, tie: Column | None = None) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` that has the same key and no later time: columns ``l`` and ``r``, structs of whole rows.

    ``r`` is null where there is none. Of right rows with the same key and time the greatest by ``tie`` (a column over ``right``; its time by
    default) counts. Rows whose key or time is null match nothing. Both sides are sorted together by ranges of key and time, so a key that has all rows is
    in many tasks; a task fills the last right row forward, and what it can't fill is in the carried row of the tasks before, of which there is one each.
    Columns may have any names, repeated rows of ``left`` stay.
    """
    order = (tie if tie is not None else F.col(right_time)).alias("tie")
    none = lambda df, c: F.lit(None).cast(df.select(c).schema[0].dataType)
    l, r = F.struct(*left.columns).alias("l"), F.struct(*right.columns).alias("r")
    rows = left.select(l, none(right, r).alias("r"), F.col(on).alias("key"), F.col(left_time).alias("time"), F.lit(1).alias("side"), none(right, order).alias("tie"))
    held = right.where(F.col(on).isNotNull() & F.col(right_time).isNotNull())
    known = held.select(none(left, l).alias("l"), r, F.col(on).alias("key"), F.col(right_time).alias("time"), F.lit(0).alias("side"), order)
    by = ["key", "time", "side", "tie", "spread"]
    both = rows.unionByName(known).withColumn("spread", F.monotonically_increasing_id())
    dealt = both.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "time", "side", "tie", "l", "r")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if key is None:
                key, last = pa.nulls(1, batch["key"].type), pa.nulls(1, batch["r"].type)
            keys, values = pa.concat_arrays([key, batch["key"]]), pa.concat_arrays([last, batch["r"]])
            own = np.r_[True, batch["side"].to_numpy(zero_copy_only=False) == 0]
            source = np.maximum.accumulate(np.where(own, np.arange(n + 1), -1))
            same = pc.fill_null(pc.equal(keys, keys.take(pa.array(source))), False).to_numpy(zero_copy_only=False)[1:]
            found = values.take(pa.array(source[1:], mask=~same))
            key, last = keys.slice(source[-1], 1), values.slice(source[-1], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), *[batch[c] for c in ("key", "time", "side", "tie", "l")], found], ["part", "key", "time", "side", "tie", "l", "r"])

    filled = stored(dealt.mapInArrow(fill, ", ".join(["part int", *(f"`{c}` {kinds[c]}" for c in ("key", "time", "side", "tie", "l", "r"))])), "filled")
    ends = filled.where("side = 0").groupBy("part").agg(F.max_by(F.struct("key", "r"), F.struct("key", "time", "tie")).alias("end"))
    parts = filled.select("part").distinct().join(F.broadcast(ends), "part", "left")  # one row for each task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("part", F.last("end", ignorenulls=True).over(before).alias("end"))
    out = filled.where("side = 1").join(F.broadcast(carried), "part", "left")
    open_ = F.col("r").isNull() & (F.col("end.key") == F.col("key")) & F.col("time").isNotNull()
    return out.select("l", F.when(F.col("time").isNotNull(), F.coalesce("r", F.when(open_, F.col("end.r")))).alias("r"))
