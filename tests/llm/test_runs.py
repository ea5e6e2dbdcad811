"""Runs against trying every period at every place."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from scriptorium.llm import queries, runs


def plain(s, exponent, least):
    """Maximal stretches of every period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((a, n, q) for (a, n), q in found.items())


words = st.lists(st.integers(0, 2), max_size=60) | st.lists(st.integers(0, 1), max_size=90)
blocks = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7)), max_size=8).map(lambda x: [w for block, n in x for w in block * n])
nested = st.lists(st.tuples(blocks, st.integers(1, 5)), max_size=3).map(lambda x: [w for block, n in x for w in block * n][:600])


@settings(deadline=None, max_examples=1500)
@given(words | blocks | nested, st.sampled_from([(2, 1), (2, 4), (3, 1), (4, 6), (4, 1), (5, 12)]))
def test_all_runs(s, rule):
    want = plain(s, *rule)
    assert runs.runs_of(s, *rule) == want
    assert runs.document_runs([str(w).encode() for w in s], *rule) == want


@settings(deadline=None, max_examples=200)
@given(words | blocks)
def test_factors(s):
    at = 0
    for start, length, earlier in runs.factors(s):
        assert start == at and s[earlier : earlier + length] == s[start : start + length]
        longest = max((n for e in range(start) for n in range(1, len(s) - start + 1) if s[e : e + n] == s[start : start + n]), default=0)
        assert length == max(1, longest) and (earlier < start if longest else earlier == start)
        at += length
    assert at == len(s)


def test_a_long_document():
    """200,000 words: one run of a long period, runs of one word, and words that repeat without a period."""
    rng = np.random.default_rng(1)
    block = rng.integers(0, 50, 12_500).tolist()
    s = [99, 98] + block * 8 + [97] * 50_000 + rng.integers(100, 5_000, 50_000).tolist()
    found = runs.document_runs([str(w).encode() for w in s])
    assert (2, 100_000, 12_500) in found and (100_002, 50_000, 1) in found


SCHEMA = "doc_id long, text string, runs string, start int"


def test_rows(spark):
    texts = [None, "", " \n\t ", "a", "a b " * 5, "x " + "a b c " * 4 + "y y y y y y y", "x" * 200_000, "é ü " * 3 + "é", "A a A a A a A a", "same", "same"]
    rows = [(None if i == 3 else i // 2, t, "x", i) for i, t in enumerate(texts)]
    got = runs.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for doc_id, text, *_ in rows:
        own = (text or "").split()
        found = plain(own, 4, 6)
        gone = {i for a, n, q in found for i in range(a + q, a + n)}
        want.append((str(doc_id), len(own), found, " ".join(w for i, w in enumerate(own) if i not in gone)))
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], bytes(r["collapsed"]).decode()) for r in got) == sorted(want)
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    """Every rule of the query over documents of which a tenth gets a period, with null and empty texts."""
    rng = np.random.default_rng(3)
    texts = [None, "", *[" ".join(f"w{x}" for x in rng.integers(0, 9, rng.integers(1, 120))) for _ in range(400)], " Repeat\tthis\nline" * 9 + " end", "a " * 40 + "b " * 40]
    folder = tmp_path / "documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(folder))
    got = {r["doc_id"]: r.asDict() for r in queries.queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for doc_id, text in enumerate(texts):
        own = (text or "").split()
        n, h = len(own), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
        found = plain(own, 4, 6)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {i for a, m, q in found for i in range(a + q, a + m)}
        assert got[doc_id] == {
            "doc_id": doc_id, "n_runs": len(found), "start": best and best[0], "length": best and best[1], "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in found).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(w for i, w in enumerate(own) if i not in gone).encode()).hexdigest(),
        }
    assert sum(r["n_runs"] for r in got.values()) > 20


@pytest.mark.parametrize("words", [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 3, [b"a", b"b"] * 4])
def test_borders_of_the_rule(words):
    assert runs.document_runs(words) == plain(words, 4, 6)
