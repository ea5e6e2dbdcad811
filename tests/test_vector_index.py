"""The vector index against all scores."""

import numpy as np
import pytest

from scriptorium.operators import retrieval, vector_index


def frames(spark, vectors, queries, key=str):
    v = spark.createDataFrame([(key(i), x.tolist()) for i, x in enumerate(vectors)], f"vec_id {'string' if key is str else 'long'}, embedding array<double>")
    q = spark.createDataFrame([(i, None if x is None else x.tolist()) for i, x in enumerate(queries)], "query_id long, vector array<double>")
    return v, q


def plain(vectors, queries, k, key, threshold=None):
    out = set()
    for i, q in enumerate(queries):
        if q is None:
            continue
        score = np.einsum("nd,d->n", vectors, q)
        found = sorted((j for j in range(len(vectors)) if threshold is None or score[j] >= threshold), key=lambda j: (-round(score[j], 9), key(j)))[:k]
        out |= {(i, key(j), n, round(float(score[j]), 6)) for n, j in enumerate(found)}
    return out


def rows(hits):
    return {(r["query_id"], r["vec_id"], r["rank"], round(r["score"], 6)) for r in hits.collect()}


@pytest.fixture(scope="module")
def clustered():
    """600 vectors around 12 centres, a third of them one and the same, whole-number scores aside."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 4
    vectors = np.round(centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 8)) * 0.2, 3)
    vectors[rng.permutation(600)[:200]] = vectors[0]
    queries = [*np.round(centres[:6] + rng.normal(size=(6, 8)) * 0.1, 3), vectors[0], np.zeros(8), None]
    return vectors, queries


@pytest.mark.parametrize("key", [str, int])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_equal_to_all_scores(spark, clustered, monkeypatch, key, k):
    for name, value in (("BLOCK", 32), ("CHUNK", 2)):  # the hot cell has many blocks, and every cell's queries several chunks
        monkeypatch.setattr(vector_index, name, value)
    v, q = frames(spark, *clustered, key)
    index = vector_index.build(v, cells=12)
    assert index.blocks.count() > 12 and index.cells.agg({"n": "sum"}).first()[0] == 600
    assert rows(vector_index.search(index, q, k)) == plain(*clustered, k, key)


def test_threshold_and_pruning(spark, clustered):
    vectors, queries = clustered
    v, q = frames(spark, vectors, queries, int)
    index = vector_index.build(v, cells=12)
    assert rows(vector_index.search(index, q, 20, threshold=30.0)) == plain(vectors, queries, 20, int, 30.0)
    report = {r["query_id"]: (r["cells"], r["reached"]) for r in vector_index.reached(index, q, 5).collect()}
    assert set(report) == set(range(8)) and all(1 <= n <= cells for cells, n in report.values())
    assert sum(n for i, (_, n) in report.items() if i < 6) < 6 * 6  # queries at a centre leave most cells out


def test_nothing_to_find(spark, clustered):
    v, q = frames(spark, *clustered, int)
    index = vector_index.build(v, cells=4)
    assert vector_index.search(index, q.limit(0), 3).count() == 0
    empty = vector_index.build(v.limit(0))
    assert vector_index.search(empty, q, 3).count() == 0 and vector_index.reached(empty, q, 3).count() == 0


def test_plan_has_no_node_for_each_block(spark, clustered, monkeypatch):
    """Many query blocks: each is done before the next is fetched, so the plan reads tables and has no Python."""
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 300)
    v, q = frames(spark, *clustered, int)
    hits = retrieval.top_k(v, q, 4)
    assert "MapInArrow" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert rows(hits) == plain(*clustered, 4, int)
