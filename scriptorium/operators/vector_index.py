"""A stored vector index and exact search on it, with queries as rows.

Vectors are dealt to the nearest of a bounded number of centres. A cell's radius is the distance of its farthest vector from its centre, so
no vector of the cell scores more than ``q . c + |q| * radius`` with a query q: by that bound whole cells are pruned, and the result is exact.
A cell's vectors are stored in blocks of bounded size, a row each.

A search deals query rows to cells: first to the cells that score best by their centres and have k vectors, which gives each query the score
that its k-th hit has at least; then to all other cells that can reach it. Queries of a cell are dealt into chunks, and a task takes one block with one
chunk, so neither a cell with a third of all vectors nor one that all queries reach is in one task. The driver holds the centres and the cells'
summaries (CELLS rows at most), never queries or vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import scratch_path, stored
from .retrieval import SCORES, _kept, _matrix, ranked

#: Most cells, vectors of a block, queries of a chunk; rows for each cell that centres are fitted on, and steps of fitting.
CELLS, BLOCK, CHUNK = 1_024, 4_096, 4_096
SAMPLED, STEPS = 32, 6
#: Scores and bounds within this share of their size may be equal but for rounding.
SLACK = 1e-9


class Index(NamedTuple):
    """``cells`` (cell, centre, radius, n, blocks) and ``blocks`` (cell, block, ids, vectors as bytes of doubles)."""

    cells: DataFrame
    blocks: DataFrame


def centres(vectors: DataFrame, cells: int) -> np.ndarray:
    """Centres fitted by Lloyd's steps on a hash-drawn sample of about SAMPLED rows for each; (vec_id, v) rows."""
    n = vectors.count()
    share = min(1.0, cells * SAMPLED / max(1, n))
    sample = vectors.where(F.pmod(F.xxhash64(F.lit("centre"), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sample.orderBy("vec_id").limit(2 * cells * SAMPLED).toArrow()["v"].combine_chunks()
    points = np.unique(_matrix(rows), axis=0) if len(rows) else np.zeros((0, 0))
    if len(points) <= cells:
        return points
    found = points[np.linspace(0, len(points) - 1, cells).astype(int)]
    for _ in range(STEPS):
        own = _nearest_centre(points, found)[0]
        size = np.bincount(own, minlength=cells)
        sums = np.zeros_like(found)
        np.add.at(sums, own, points)
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], found)
    return np.unique(found, axis=0)


def _nearest_centre(points: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and the distance from it."""
    half = (found**2).sum(axis=1) / 2
    own = np.concatenate([np.argmax(points[i : i + 4096] @ found.T - half, axis=1) for i in range(0, len(points), 4096)])
    return own, np.sqrt(((points - found[own]) ** 2).sum(axis=1))


def build(vectors: DataFrame, cells: int | None = None, path: str | None = None, vector_col: str = "embedding", id_col: str = "vec_id") -> Index:
    """Indexes every vector that isn't null, under ``path`` (a scratch folder by default).

    ``cells`` is about the root of the number of vectors by default, CELLS at most. Repeated ids are vectors of their own; an empty
    table gives an empty index.
    """
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "vector-index")
    base = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fitted = centres(base, min(CELLS, cells or 1 + int(base.count() ** 0.5)))
    id_type = base.schema["vec_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, distance = _nearest_centre(_matrix(batch.column(1)), fitted)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(distance), *batch.columns], ["cell", "distance", "vec_id", "v"])

    dealt = stored(base.mapInArrow(deal, f"cell int, distance double, vec_id {id_type}, v array<double>"), "dealt")
    sizes = dealt.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    at = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted)], "cell int, centre array<double>")
    at.join(sizes, "cell").write.parquet(f"{path}/cells")
    summary = spark.read.parquet(f"{path}/cells")
    block = F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({
            "cell": table["cell"][:1], "block": table["block"][:1],
            "ids": pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table["vec_id"].combine_chunks()),
            "vectors": pa.array([_matrix(table["v"].combine_chunks()).tobytes()], pa.binary()),
        })

    placed = dealt.join(F.broadcast(summary.select("cell", "blocks")), "cell").select("cell", block.alias("block"), "vec_id", "v")
    placed.groupBy("cell", "block").applyInArrow(pack, f"cell int, block int, ids array<{id_type}>, vectors binary").write.parquet(f"{path}/blocks")
    return read(spark, path)


def read(spark, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/blocks"))


def _dealt(asked: DataFrame, cells: DataFrame, k: int, rest: bool) -> DataFrame:
    """(cell, query_id, v, floor) for the cells that a query is dealt to: the first ones, or with ``rest`` all others that reach ``floor``."""
    rows = cells.orderBy("cell").toArrow()  # CELLS rows at most
    if not rows.num_rows:
        return asked.select(F.lit(0).alias("cell"), "query_id", "v", "floor").limit(0)
    own, radius, n = (rows[c].to_numpy() for c in ("cell", "radius", "n"))
    centre = _matrix(rows["centre"].combine_chunks())
    length = np.sqrt((centre**2).sum(axis=1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, SCORES // len(own))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                q = _matrix(batch.column(1))
                score = q @ centre.T
                order = np.argsort(-score, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                chosen = np.zeros(score.shape, bool)
                np.put_along_axis(chosen, order, before < k, axis=1)
                if rest:
                    size = np.sqrt((q**2).sum(axis=1))[:, None]
                    slack = SLACK * (1 + size * (length + radius))
                    chosen = ~chosen & (score + size * radius + slack >= batch.column(2).to_numpy(zero_copy_only=False)[:, None])
                row, cell = np.nonzero(chosen)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(own[cell], pa.int32()), *[c.take(row) for c in batch.columns]], ["cell", "query_id", "v", "floor"])

    kind = asked.schema["query_id"].dataType.simpleString()
    return asked.select("query_id", "v", "floor").mapInArrow(deal, f"cell int, query_id {kind}, v array<double>, floor double")


def _scored(dealt: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each block and chunk, the ``k`` best of each query that reach its floor."""
    blocks = F.broadcast(index.cells.select("cell", "blocks"))
    chunks = dealt.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # a row for each cell
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = dealt.join(F.broadcast(chunks), "cell").join(blocks, "cell")
    asks = asks.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).withColumn("block", each("blocks")).select("cell", "block", "chunk", "query_id", "v", "floor")
    held = index.blocks.join(F.broadcast(chunks), "cell").withColumn("chunk", each("chunks")).drop("chunks")
    query_type = dealt.schema["query_id"].dataType.simpleString()
    id_type = index.blocks.schema["ids"].dataType.elementType.simpleString()

    def score(asked: pa.Table, block: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(asked) or not len(block):
            return pa.table([asked["query_id"][:0], block["ids"].combine_chunks().flatten()[:0], pa.array([], pa.float64())], names)
        q, ids = _matrix(asked["v"].combine_chunks()), block["ids"].combine_chunks().flatten()
        vectors = np.frombuffer(block["vectors"][0].as_py()).reshape(len(ids), -1)
        floor, keys = asked["floor"].to_numpy(), ids.to_pandas().to_numpy()
        slack = SLACK * (1 + np.sqrt((q**2).sum(axis=1)) * np.sqrt((vectors**2).sum(axis=1).max()))
        hits = []
        for at in range(0, len(q), step := max(1, SCORES // len(ids))):
            part = slice(at, at + step)
            row, place = np.nonzero(q[part] @ vectors.T >= (floor[part] - slack[part])[:, None])
            exact = np.einsum("nd,nd->n", q[row + at], vectors[place])
            good = exact >= floor[row + at]
            hits.append(_kept(row[good] + at, exact[good], keys[place[good]], k))
        row, exact, own = (np.concatenate([h[i] for h in hits]) for i in range(3))
        return pa.table([asked["query_id"].combine_chunks().take(pa.array(row)), pa.array(own, ids.type), pa.array(exact)], names)

    return asks.groupBy("cell", "block", "chunk").cogroup(held.groupBy("cell", "block", "chunk")).applyInArrow(score, f"query_id {query_type}, vec_id {id_type}, score double")


def _asked(queries: DataFrame, threshold: float | None) -> DataFrame:
    floor = F.lit(float("-inf") if threshold is None else float(threshold))
    return queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("v"), floor.alias("floor"))


def _first(index: Index, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Stored hits of the cells that each query goes to first, and the queries with the score that they must reach elsewhere."""
    hits = stored(_scored(_dealt(asked, index.cells, k, False), index, k), "first-hits")
    kth = ranked(hits, k).where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("kth"))
    return hits, asked.join(kth, "query_id", "left").select("query_id", "v", F.greatest("floor", F.coalesce("kth", "floor")).alias("floor"))


def search(index: Index, queries: DataFrame, k: int = 50, threshold: float | None = None) -> DataFrame:
    """Exact inner-product search like ``retrieval.top_k``: (query_id, vec_id, score, rank) of the ``k`` best vectors for each query (query_id, vector).

    Ties go by vec_id; null vectors of queries ask nothing; a ``threshold`` drops lower scores; fewer than ``k`` vectors are all hits.
    """
    hits, again = _first(index, _asked(queries, threshold), k)
    return ranked(hits.unionByName(_scored(_dealt(again, index.cells, k, True), index, k)), k)


def reached(index: Index, queries: DataFrame, k: int = 50, threshold: float | None = None) -> DataFrame:
    """(query_id, cells, reached): how many cells there are, and with how many of them :func:`search` compares a query; the rest is pruned."""
    asked = _asked(queries, threshold)
    _, again = _first(index, asked, k)
    dealt = _dealt(asked, index.cells, k, False).unionByName(_dealt(again, index.cells, k, True))
    return dealt.groupBy("query_id").agg(F.count("*").alias("reached")).crossJoin(index.cells.agg(F.count("*").alias("cells"))).select("query_id", "cells", "reached")
