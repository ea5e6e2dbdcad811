"""Sparse search, joins on order, sketches, cubes and pages against plain statements of their rules."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import paging, sparse, summaries, temporal


# Sparse search.


def plain_bm25(docs, queries, k):
    cut = {i: [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "")).lower().split()] for i, t in docs if i is not None}
    mean = sum(map(len, cut.values())) / len(cut) or 1.0
    df = Counter(w for ws in cut.values() for w in set(ws))
    out = set()
    for q, text in queries:
        times = Counter(w for w in (text or "").lower().split() if w in df)
        score = {}
        for i, ws in cut.items():
            tf = Counter(ws)
            if any(tf[w] for w in times):
                score[i] = round(sum(n * math.log(1 + (len(cut) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, n in times.items() if tf[w]), 9)
        out |= {(q, i, n, round(score[i], 6)) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:k])}
    return out


@pytest.mark.parametrize("k", [1, 5, 500])
def test_bm25_against_all_scores(spark, monkeypatch, k):
    monkeypatch.setattr(sparse, "CHUNK", 2)  # queries of a term in several chunks
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 40), p=np.arange(60, 0, -1) / 1830))) for i in range(300)]
    docs += [(300 + i, "hot hot w3 copy") for i in range(100)] + [(400, None), (401, ""), (402, "... !"), (None, "hot w3")]
    queries = [(0, "w3 w59"), (1, "hot"), (2, "HOT w58 w58 w1"), (3, "unknown"), (4, None), (5, "w0"), (6, "copy w59 w57")]
    index = sparse.build(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, term string"), block_docs=16)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    got = {(r["query_id"], r["doc_id"], r["rank"], round(r["score"], 6)) for r in sparse.bm25(index, asked, k).collect()}
    assert got == plain_bm25(docs, queries, k)
    if k == 1:
        assert all(1 <= r["scored"] <= r["blocks"] for r in sparse.blocks_scored(index, asked, k).collect())
        assert sum(r["blocks"] - r["scored"] for r in sparse.blocks_scored(index, asked, k).collect()) > 0


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert sparse.bm25(sparse.build(docs.limit(0)), asked).count() == 0
    assert sparse.bm25(sparse.build(docs), asked.limit(0)).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 12, 0)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], "query_id long, doc_id long, rank int")
    got = [(r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in sparse.fused([a, b], 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11, 0, round(1 / 61 + 1 / 62, 12)), (1, 10, 1, round(1 / 61, 12)), (2, 12, 0, round(1 / 61, 12))]


# Intervals.

SPANS = "k string, start long, stop long, l int, bin string"


def plain_pairs(a, b):
    return Counter((x[3], y[3]) for x in a for y in b if x[0] is not None and x[0] == y[0] and None not in (*x[1:3], *y[1:3]) and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])


@pytest.mark.parametrize("width", [1, 16, 1000])
def test_interval_join(spark, width):
    """One hot key, very long intervals on both sides, negative places, empty intervals, nulls, repeated rows; columns with the operator's names."""
    rng = np.random.default_rng(width)
    rows = lambda n, at: [(str(rng.choice(["hot", "hot", "hot", "b", "c"])), int(s), int(s + rng.integers(0, 30)), at + i, "x") for i, s in enumerate(rng.integers(-200, 2_000, n))]
    a, b = rows(150, 0), rows(200, 1000)
    a += [("hot", -10_000_000, 50_000_000, 500, "x"), ("b", 5, 900, 501, "x"), (None, 0, 9, 502, "x"), ("hot", None, 9, 503, "x"), ("hot", 7, 7, 504, "x"), ("hot", 9, 3, 505, "x")]
    b += [("hot", -5, 40_000_000, 2000, "x"), (None, 0, 9, 2001, "x"), ("c", 0, None, 2002, "x")] + [("hot", 10, 20, 2003, "x")] * 3
    left, right = spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS)
    found = temporal.interval_join(left, right, ["k"], ("start", "stop"), ("start", "stop"), width)
    assert Counter((r["l"]["l"], r["r"]["l"]) for r in found.collect()) == plain_pairs(a, b)
    assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    assert temporal.interval_join(left.limit(0), right, ["k"], ("start", "stop"), ("start", "stop"), width).count() == 0


# As of.


def plain_asof(a, b):
    out = []
    for i, (k, t) in enumerate(a):
        best = max(((u, n) for n, (q, u) in enumerate(b) if k is not None and t is not None and q == k and u is not None and u <= t), default=None)
        out.append((i, best and best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("keys", [["only"], ["a", "b", "c", "d"]])
def test_asof_join(spark, keys):
    """One key with all rows, and few keys: many tasks each; ties in time, rows before the first, nulls."""
    rng = np.random.default_rng(len(keys))
    a = [(str(rng.choice(keys)), int(t)) for t in rng.integers(0, 900, 800)] + [(None, 5), ("only", None), ("nowhere", 5), ("only", 0)]
    b = [(str(rng.choice(keys)), int(t)) for t in rng.integers(100, 900, 40)] + [(None, 5), ("only", None), ("a", 300), ("a", 300)]
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "part int, key string, time int")
    right = spark.createDataFrame([(n, *x) for n, x in enumerate(b)], "tie int, key string, time int")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = temporal.asof_join(left, right, "key", "time", "time", F.col("tie")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(((r["l"]["part"], r["r"] and r["r"]["tie"]) for r in found), key=str) == plain_asof(a, b)
    assert temporal.asof_join(left.limit(0), right, "key", "time", "time").count() == 0
    assert temporal.asof_join(left, right.limit(0), "key", "time", "time").where("r IS NOT NULL").count() == 0


# Sketches.


def test_sketches_within_their_bounds(spark):
    """100,000 values in 40 parts, merged twice: ranks within the stated error, distinct counts too."""
    rows = spark.range(100_000).selectExpr("id % 40 AS day", "CAST(pmod(xxhash64(id), 1000003) AS DOUBLE) AS x", "id % 5000 AS who")
    parts = summaries.sketched(rows, ["day"], "x", "who")
    weeks = summaries.merged(parts, [F.floor(F.col("day") / 7).alias("week")])
    whole = summaries.spread(summaries.merged(weeks, []), [], (0.01, 0.25, 0.5, 0.75, 0.99)).first()
    values = np.sort(rows.toPandas()["x"].to_numpy())
    assert whole["n"] == 100_000 and abs(whole["mean"] - values.mean()) < 1e-6 * values.mean() and abs(whole["std"] - values.std()) < 1e-6 * values.std()
    for share, q in zip((0.01, 0.25, 0.5, 0.75, 0.99), whole["quantiles"], strict=True):
        assert abs(np.searchsorted(values, q) / 100_000 - share) <= whole["rank_error"]
    assert abs(whole["distinct"] - 5000) <= 5000 * 2 * summaries.DISTINCT_ERROR
    assert weeks.count() == 6 and (whole["low"], whole["high"]) == (values[0], values[-1])


def test_sketches_of_nulls(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", 1.0, "u"), ("b", None, "v")], "g string, x double, who string")
    got = {r["g"]: r for r in summaries.spread(summaries.sketched(rows, ["g"], "x", "who"), ["g"]).collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["quantiles"], got["a"]["distinct"]) == (0, None, None, 0)
    assert (got["b"]["n"], got["b"]["quantiles"], got["b"]["std"], got["b"]["distinct"]) == (1, [1.0] * 3, 0.0, 2)


def test_cube_is_one_shuffle(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "x", 3), ("b", "x", 5)], "g string, h string, n int")
    found = summaries.metrics_cube(rows, ["g", "h"], "n", {"big": F.col("n") > 2})
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r["g"], r["h"], r["level"]): (r["n"], r["total"], r["big_share"]) for r in found.collect()}
    assert got[None, None, 3] == (3, 9, 2 / 3) and got["a", None, 0] == (1, 1, 0.0) and got["a", None, 1] == (2, 4, 0.5) and got[None, "x", 2] == (2, 8, 1.0) and len(got) == 8


# Pages.


def test_pages(spark):
    rows = [(None if i % 50 == 0 else i * 7919 % 1000, f"v{i}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "row int, part string, place int").repartition(5)
    table = paging.ordered(df, ["row", "place"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    for start, size in [(0, 10), (495, 300), (990, 50), (2000, 5), (3, 0), (0, 5000)]:
        got = paging.page(table, start, size)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want[start : start + size], key=str) and got.columns == df.columns
    plan = paging.page(table, 990, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "PartitionFilters: [" in plan and "Exchange" not in plan
    assert paging.page(paging.ordered(df.limit(0), "row"), 0, 5).count() == 0
