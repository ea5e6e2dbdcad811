"""Vectors as arrays of floats; sums are taken in double."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import col, let


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column | str) -> Column:
    """Divided by its Euclidean norm; a zero vector stays."""
    divided = lambda n: F.when(n > 0, F.transform(col(v), lambda x: x.cast("double") / n)).otherwise(F.transform(col(v), lambda x: x.cast("double")))
    return let(norm(v), divided)  # else each element would take the norm anew


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_cosine(vectors: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """(by, vectors, coherence): each group's number of vectors and the mean cosine of all pairs of different ones; null below two.

    For unit vectors it is (|sum|^2 - n) / (n (n - 1)), which needs no pairs: a task sums its unit vectors for each group, so a group of any
    size is one row for each task in the shuffle. Zero vectors count 0 with any other; null vectors don't count; a null group is one.
    """
    kind = vectors.schema[by].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            length = np.sqrt((v**2).sum(axis=1))
            unit = v / np.where(length > 0, length, 1)[:, None]
            keys = batch.column(0).dictionary_encode("encode")
            code, n = keys.indices.to_numpy(), len(keys.dictionary)
            sums = np.zeros((n, v.shape[1]))
            np.add.at(sums, code, unit)
            yield pa.RecordBatch.from_arrays(
                [keys.dictionary, pa.array(list(sums), pa.list_(pa.float64())), pa.array(np.bincount(code, minlength=n), pa.int64()), pa.array(np.bincount(code, length > 0, n).astype(np.int64), pa.int64())], ["key", "sums", "n", "own"]
            )

    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(by).alias("key"), F.col(vector_col).cast("array<double>").alias("v"))
    parts = rows.mapInArrow(partial, f"key {kind}, sums array<double>, n long, own long")
    whole = parts.select("key", F.posexplode("sums").alias("i", "x"), F.when(F.col("i") == 0, F.col("n")).alias("n"), F.when(F.col("i") == 0, F.col("own")).alias("own"))
    sums = whole.groupBy("key", "i").agg(F.sum("x").alias("s"), F.sum("n").alias("n"), F.sum("own").alias("own")).groupBy("key")
    found = sums.agg(F.sum(F.col("s") * F.col("s")).alias("total"), F.sum("n").alias("n"), F.sum("own").alias("own"))
    n = F.col("n")
    return found.select(F.col("key").alias(by), n.alias("vectors"), F.when(n >= 2, (F.col("total") - F.col("own")) / (n * (n - 1))).alias("coherence"))
