"""Exact deduplication against grouping in plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import exactdedup, queries

SCHEMA = "doc_id long, text string, digest string, row int"


def digests(keys):
    return [hashlib.sha256(str(k).encode()).digest() for k in keys]


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(), max_size=400), st.sets(st.integers(), max_size=50))
def test_slots_are_a_permutation_and_members_are_told_by_bytes(members, others):
    members, others = sorted(members), sorted(others - members)
    own = digests(members)
    levels = exactdedup.perfect_hash(exactdedup.words_of(own))
    found = exactdedup.slots(levels, exactdedup.words_of(own))
    assert sorted(found.tolist()) == list(range(len(own)))
    held = [own[i] for i in np.argsort(found)]
    for digest, slot in zip(digests(others), exactdedup.slots(levels, exactdedup.words_of(digests(others))).tolist(), strict=True):
        assert slot < 0 or held[slot] != digest


def test_repeated_digests_are_refused():
    with pytest.raises(ValueError):
        exactdedup.perfect_hash(exactdedup.words_of(digests([1, 2, 1])))


def plain(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[text or ""].append((doc_id is not None, doc_id or 0, i))
    best = {t: max(x)[:2] for t, x in groups.items()}
    return sorted(
        (str(d), str(best[t or ""][1] if best[t or ""][0] else None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows
    )


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "only null"), (None, "only null"), (7, "b"), (7, "b"), (7, "other"), (8, "A"), (9, "a "), (10, "\U0001f600é" * 40_000), (11, "\U0001f600é" * 40_000)]


@pytest.mark.parametrize("history", ["true", "false", "doc_id % 2 = 0", "doc_id > 3"])
def test_rows_nulls_and_ties(spark, history):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    got = exactdedup.exact_duplicates(docs, F.expr(history)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == plain(ROWS)
    kept = [r for r in got if r["kept"]]
    assert len({r["text_sha256"] for r in kept}) == len(kept) == len({t or "" for _, t in ROWS})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exactdedup.exact_duplicates(empty, F.lit(True)).count() == 0
    index = exactdedup.history_index(exactdedup.digested(empty), 4)
    docs = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2)], SCHEMA)
    assert [r["digest"] for r in exactdedup.new_documents(docs, index, 4).collect()] == ["y"]


def test_new_documents_of_a_batch(spark):
    history = spark.createDataFrame([(1, "old", "h", 0), (2, None, "h", 0)], SCHEMA)
    index = exactdedup.stored(exactdedup.history_index(exactdedup.digested(history), 8), "index")
    batch = spark.createDataFrame([(5, "old", "x", 1), (6, "", "x", 1), (7, "new", "x", 1), (9, "new", "y", 2), (9, "new", "y", 2), (None, "new", "z", 3)], SCHEMA)
    assert [tuple(r) for r in exactdedup.new_documents(batch, index, 8).collect()] == [(9, "new", "y", 2)]


def test_one_text_in_most_rows(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 7000)).alias("text"))
    got = exactdedup.exact_duplicates(docs, F.expr("doc_id % 2 = 0"))
    sizes = got.groupBy("text_sha256").agg(F.count("*").alias("n"), F.max("group_size").alias("m"), F.min("group_size").alias("l"), F.max("keep_id").alias("k"), F.max("doc_id").alias("d"), F.sum(F.col("kept").cast("int")).alias("one"))
    assert sizes.where("n <> m OR m <> l OR k <> d OR one <> 1").count() == 0
    assert got.count() == 30_000


def test_query_equals_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    rel = con.execute(queries.oracle_sql()["op12_exact_dedup"])
    names = [c[0] for c in rel.description]
    got = queries.queries()["op12_exact_dedup"](spark, data)
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())
    assert set(got.columns) == set(names)
