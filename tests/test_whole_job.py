"""Queries take their whole input: no subset of ids or rows."""

import duckdb
import numpy as np
import pytest

from scriptorium.operators import operations
from scriptorium.plans import catalog


def rows_of(data, sql):
    return duckdb.connect().execute(sql.format(data=data)).fetchall()


@pytest.mark.parametrize("name, k", [("vector_topk", 10), ("vector_threshold", 10), ("vector_two_phase", 10), ("citations_first_per_paper", None), ("prompt_sources", None)])
def test_search_takes_every_due_query(spark, data, name, k):
    vectors = rows_of(data, "SELECT vec_id, embedding, label FROM '{data}/embeddings.parquet' ORDER BY vec_id")
    ids, v, label = np.array([r[0] for r in vectors]), np.array([r[1] for r in vectors], float), np.array([r[2] for r in vectors])
    due = [i for i in ids.tolist() if i % 20 == 0]
    got = catalog.queries()[name](spark, data).collect()
    assert len(due) > 5 or len(ids) <= 100
    if name != "vector_threshold":  # every due query has hits
        assert sorted({r["query_id"] for r in got}) == due
    if k:
        want = set()
        for i in due:
            score = v @ v[ids == i][0]
            if name == "vector_two_phase":
                first = np.lexsort((ids, -score))[:75]
                rank = first[np.lexsort((ids[first], -(np.round(score[first], 6) - label[first] * 0.01)))[:k]]
            else:
                rank = [j for j in np.lexsort((ids, -score))[:k] if name == "vector_topk" or score[j] >= 0.3]
            want |= {(i, int(ids[j]), n) for n, j in enumerate(rank)}
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got} == want


def test_modulo_shards_places_every_document(spark, data):
    ids = sorted(r[0] for r in rows_of(data, "SELECT doc_id FROM '{data}/documents.parquet'"))
    assert sorted(r["doc_id"] for r in catalog.queries()["modulo_shards"](spark, data).collect()) == ids[2::7]


def test_modulo_shard_over_gaps(spark):
    gaps = spark.createDataFrame([(i * i,) for i in range(40)], "doc_id long").repartition(3)
    assert sorted(r["doc_id"] for r in operations.modulo_shard(gaps, "doc_id", 2, 7).collect()) == [i * i for i in range(2, 40, 7)]
