"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

from scriptorium.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def compare(spark, data, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = run(spark, data)
    columns = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    compare(spark, data, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    df = catalog.queries()[name](spark, data)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_hashed_search_plainly(spark, data):
    """The one query that SQL can't state: hashed embeddings, all scores, ties by id, reranked by shared words."""
    import numpy as np

    from scriptorium.functions.models import HashedWords, overlap_reranker

    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id::VARCHAR, text FROM '{data}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{data}/benchmark.parquet'").fetchall()
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    ids, texts = np.array([d[0] for d in docs], object), [d[1] for d in docs]
    v = unit(HashedWords()(texts).astype(float)).astype(np.float32).astype(float)
    got = {}
    for r in catalog.queries()["hashed_embedding_search"](spark, data).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["chunk_id"], round(r["score"], 9))
    for item, text in items:
        score = np.round(v @ unit(HashedWords()([text]).astype(float))[0], 12)
        first = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:10]
        again = overlap_reranker([text] * 10, [texts[i] for i in first])
        best = sorted(zip(again, (ids[i] for i in first), strict=True), key=lambda x: (-x[0], x[1]))[:5]
        assert [got[item][n][1] for n in range(5)] == [round(s, 9) for s, _ in best]
