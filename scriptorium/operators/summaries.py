"""Mergeable summaries: quantile and distinct sketches as stored columns, and metrics for all combinations of groups in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Items that a quantile sketch keeps on its lowest level; the rank of a quantile is off by RANK_ERROR of all values at most (99 % confidence).
KLL_K, RANK_ERROR = 400, 0.0075
#: Two to this power registers of a distinct sketch; its count is off by 2 * DISTINCT_ERROR in 95 of 100 cases.
HLL_LG_K, DISTINCT_ERROR = 14, 0.0065


def sketched(rows: DataFrame, by: list[str | Column], value_col: str, distinct_col: str | None = None, k: int = KLL_K) -> DataFrame:
    """A row for each group with n, total, squares, low, high and the sketches ``quantiles`` and, of ``distinct_col``, ``distinct``.

    All of them are made by partial aggregation, so a group's values never meet in one task; the table is stored as it is and merged for
    any coarser grouping by :func:`merged`. Null values don't count.
    """
    value = F.col(value_col).cast("double")
    numbers = [F.count(value).alias("n"), F.sum(value).alias("total"), F.sum(value * value).alias("squares"), F.min(value).alias("low"), F.max(value).alias("high")]
    sketches = [F.kll_sketch_agg_double(value, k).alias("quantiles")]
    if distinct_col:
        sketches.append(F.hll_sketch_agg(F.col(distinct_col).cast("string"), HLL_LG_K).alias("distinct"))
    return rows.groupBy(*by).agg(*numbers, *sketches)


def merged(sketches: DataFrame, by: list[str | Column]) -> DataFrame:
    """Sketch rows of many groups as rows of fewer, larger groups; the same columns."""
    sums = [F.sum(c).alias(c) for c in ("n", "total", "squares")] + [F.min("low").alias("low"), F.max("high").alias("high")]
    parts = [F.kll_merge_agg_double("quantiles").alias("quantiles")]
    if "distinct" in sketches.columns:
        parts.append(F.hll_union_agg("distinct").alias("distinct"))
    return sketches.groupBy(*by).agg(*sums, *parts)


def spread(sketches: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The numbers behind box plots from sketch rows: n, mean, std (of the population), low, high, ``quantiles`` (an array) and the count of distinct values.

    A quantile's rank is within RANK_ERROR of what was asked, ``rank_error`` says so in a column.
    """
    n = F.col("n")
    mean = F.try_divide(F.col("total"), n)
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("squares"), n) - mean * mean))
    quantiles = F.when(n > 0, F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(s) for s in shares])))
    out = [n, mean.alias("mean"), std.alias("std"), "low", "high", quantiles.alias("quantiles"), F.lit(RANK_ERROR).alias("rank_error")]
    if "distinct" in sketches.columns:
        out.append(F.hll_sketch_estimate("distinct").alias("distinct"))
    return sketches.select(*keys, *out)


def metrics_cube(rows: DataFrame, by: list[str], value_col: str, flags: dict[str, Column]) -> DataFrame:
    """Counts, sums, extremes and the share of rows with each flag, for every combination of ``by`` in one pass and one shuffle.

    ``level`` is the grouping id: a bit for each key, the first the highest, set where the row is over all values of the key. So a null key with
    its bit unset is a group of nulls. Shares come from summed counts, not from shares of parts; null flags count as no.
    """
    sums = {name: F.sum(F.coalesce(flag, F.lit(False)).cast("long")).alias(name) for name, flag in flags.items()}
    found = rows.cube(*by).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum(value_col).alias("total"), F.min(value_col).alias("low"), F.max(value_col).alias("high"), *sums.values())
    shares = [(F.col(name) / F.col("n")).alias(f"{name}_share") for name in flags]
    return found.select(*by, "level", "n", "total", "low", "high", (F.col("total") / F.col("n")).alias("mean"), *shares)
