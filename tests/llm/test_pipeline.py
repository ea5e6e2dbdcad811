"""The pipeline's stages against brute force on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import langid, license_scan, mixing, queries

from .test_brute_force import mixture_plainly
from .test_llm_operators import LOW, components


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    known = stages["language ID"](spark, docs, data)
    assert known.columns == docs.columns and known.count() > 0.97 * docs.count()
    model = langid.train(docs.where(~langid.held_out()))
    kept = {r["doc_id"] for r in known.collect()}
    rows = docs.orderBy(F.length("text"), "doc_id").collect()
    for r in [*rows[:30], *rows[60:70]]:  # the shortest, which are hardest to tell, and some others
        mixture = mixture_plainly(r["text"], model) if any(map(str.isalpha, r["text"] or "")) else {}
        best = max(mixture.values(), default=0.0)
        assert abs(best - 0.5) < 2e-3 or (r["doc_id"] in kept) == (best >= 0.5), r
    strange = docs.sparkSession.createDataFrame([(-1, "½ Ⅷ 12 !!", "en", "s", 9), (-2, None, "en", "s", 0)], docs.schema)
    assert stages["language ID"](spark, docs.unionByName(strange), data).where("doc_id < 0").count() == 0

    once = stages["near-duplicates"](spark, known, data)
    groups = components([(r["doc_id"], r["text"]) for r in known.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)

    clean = stages["decontamination"](spark, once, data)
    words = lambda t: re.findall(license_scan.WORD, t.translate(LOW))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    items = [grams(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    own = {r["doc_id"]: grams(r["text"]) for r in once.collect()}
    leaks = {i for i, g in own.items() if any(100 * len(g & x) >= 80 * len(x) for x in items)}
    assert leaks and {r["doc_id"] for r in clean.collect()} == set(own) - leaks

    mixed = stages["mixing"](spark, clean, data)
    sizes = {}
    for r in clean.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").encode())
    roots = sum(math.sqrt(n) for n in sizes.values())
    rate = {s: round(math.sqrt(n) / roots * sum(sizes.values()) / n, 9) for s, n in sizes.items()}

    def copies(doc_id, lam):
        u = (int(hashlib.md5(f"7:{doc_id}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = math.exp(-lam)
        k = 0
        while c <= u:
            k += 1
            p *= lam / k
            c += p
        return k

    want = Counter({r["doc_id"]: copies(r["doc_id"], rate[r["source"]]) for r in clean.collect()})
    want = [i for i, n in want.items() for _ in range(n)]
    assert max(rate.values()) <= mixing.PART and mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(want)

    out = stages["token ids"](spark, mixed, data).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(out) == len(want)
    for r in out:
        ids = [*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    ends = sorted((r["start"], r["n_tokens"]) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_repeated_ids_and_run(spark, data):
    """Rows whose ids repeat go through all stages: clean ones stay, equal ones once; and the whole run gives the last stage's columns."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    a, b = (" ".join(f"{w}{i % 7}the of and" for i in range(80)) for w in ("river", "mountain"))
    twice = spark.createDataFrame([(7_000_001, a, "en", "s", 9), (7_000_001, b, "en", "s", 9), (7_000_001, b, "en", "s", 9), (None, a, "en", "s", 9)], docs.schema)
    rows = docs.unionByName(twice)
    for name, stage in corpus_pipeline.STAGES[:3]:
        rows = stage(spark, rows, data)
        assert rows.columns == docs.columns, name
    texts = sorted(r["text"] for r in rows.where("doc_id = 7000001 OR doc_id IS NULL").collect())
    assert texts == sorted([a, a, b])
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert out.count() == 0
        docs = out if set(docs.columns) <= set(out.columns) else docs
