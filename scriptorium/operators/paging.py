"""Pages of a sorted table by order statistics: stored ranges with counts, of which a page reads those that it lies in."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..scratch import scratch_path


class Ordered(NamedTuple):
    """``rows`` (row, part, place) in a folder for each range, sorted there, and ``ranges`` (part, start, n)."""

    rows: DataFrame
    ranges: DataFrame


def ordered(df: DataFrame, order: str | list[str], path: str | None = None) -> Ordered:
    """Stores ``df`` in ranges of the order (ascending, nulls first) with each row's place in its range; rows equal in it are interchangeable.

    One shuffle, whatever number of pages is read later. Columns may have any names.
    """
    path = path or scratch_path(df.sparkSession, "ordered")
    names = [order] if isinstance(order, str) else list(order)
    keys = [F.col(f"k{i}").asc_nulls_first() for i in range(len(names))] + [F.col("spread")]
    packed = df.select(F.struct(*df.columns).alias("row"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("spread"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = packed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", F.spark_partition_id().alias("part"), place.alias("place"))
    dealt.write.partitionBy("part").parquet(f"{path}/rows")
    return read(df.sparkSession, path, dealt.schema)


def read(spark, path: str, schema=None) -> Ordered:
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(f"{path}/rows")
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())  # one for each range
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total, n))
        total += n
    return Ordered(rows, spark.createDataFrame(starts, "part int, start long, n long"))


def page(table: Ordered, start: int, size: int) -> DataFrame:
    """``size`` rows from place ``start`` (from 0) on, with the columns of the table: the folders of other ranges aren't read.

    Pages over the end are short or empty. The rows come sorted within ranges; sort the page where its own order is to be shown.
    """
    inside = table.ranges.where((F.col("start") < start + size) & (F.col("start") + F.col("n") > start)).collect()
    wanted = F.lit(False)
    for r in inside:
        low, high = max(0, start - r["start"]), min(r["n"], start + size - r["start"])
        wanted = wanted | ((F.col("part") == r["part"]) & (F.col("place") >= low) & (F.col("place") < high))
    found = table.rows.where(F.col("part").isin([r["part"] for r in inside]) & wanted)
    return found.select("row.*")
