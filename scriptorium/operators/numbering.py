"""Global row numbers without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import stored


def numbered(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """Adds ``row_number`` (long, from 0): a row's place by ascending keys of any type, nulls first; also returns the number of rows.

    Rows are dealt into ranges of the order and sorted there, written to the scratch folder with each row's place in its
    range, and offset by the counts of the ranges before; the driver gets one count for each range. Rows equal in the whole
    order are interchangeable, so a last range key spreads even a run of equal rows. Columns may have any names.
    """
    keys = {f"k{i}": key for i, key in enumerate(order)}
    by = [*[F.col(k).asc_nulls_first() for k in keys], F.col("spread")]
    packed = df.select(F.struct(*df.columns).alias("row"), *[c.alias(k) for k, c in keys.items()], F.monotonically_increasing_id().alias("spread"))
    place_in = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = packed.repartitionByRange(*by).sortWithinPartitions(*by)
    table = stored(dealt.select("row", F.spark_partition_id().alias("part"), place_in.alias("place")), "numbered")
    counts = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.count("*").alias("n")).collect())
    total, starts = 0, []
    for part, n in counts:
        starts.append((part, total))
        total += n
    unpacked = [F.col("row")[c].alias(c) for c in df.columns]
    if not starts:
        return table.select(*unpacked, F.col("place").alias("row_number")), 0
    rows = ", ".join(f"({p}, {s}L)" for p, s in starts)  # one row for each range
    offsets = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(part, start)")
    joined = table.join(F.broadcast(offsets), "part")
    return joined.select(*unpacked, (F.col("start") + F.col("place")).alias("row_number")), total
