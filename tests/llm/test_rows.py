"""Decisions by row where ids are missing or repeat, and bounds of models and broadcasts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import decontaminate, langid, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "which of these seven rivers reaches the northern sea in early spring"
CLEAN = "a plain paragraph about bread and salt that no test has ever asked about"


@pytest.mark.parametrize("block_shingles", [2_000_000, 20])
@pytest.mark.parametrize("most", [decontaminate.BROADCAST_DIGESTS, 0])
def test_contaminated_rows_go_and_no_others(spark, monkeypatch, block_shingles, most):
    """Ids are null, and shared by clean and contaminated rows; columns have names that the operator uses itself."""
    monkeypatch.setattr(decontaminate, "BROADCAST_DIGESTS", most)
    rows = [(None, f"x {ITEM} y"), (None, CLEAN), (5, ITEM), (5, CLEAN), (5, CLEAN), (6, None), (7, ""), (None, None), (8, ITEM.upper() + "!")]
    docs = spark.createDataFrame([(i, t, "own", "hit", "doc") for i, t in rows], "doc_id long, text string, own string, of_text string, doc string")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "another item of many other words that is in no document at all")], "item_id long, text string")
    got = decontaminate.decontaminated(docs, bench, block_shingles=block_shingles)
    assert got.columns == docs.columns
    want = [(i, t) for i, t in rows if not t or "rivers" not in t.lower()]
    assert sorted(map(str, (tuple(r)[:2] for r in got.collect()))) == sorted(map(str, want))
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.decontaminated(docs.limit(0), bench).count() == 0


def test_pipeline_over_rows_without_id(spark, data, tmp_path):
    """Null and repeated ids through all stages: no test item gets into the token files, no clean text is lost."""
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    clean = [r["text"] for r in docs.where("lang = 'en' AND length(text) BETWEEN 500 AND 900").orderBy("doc_id").limit(2).collect()]
    more = spark.createDataFrame([(None, f"{clean[0]} {item}", "en", "s", 1), (-5, f"{item} {clean[1]}", "en", "s", 1), (-5, " ".join(reversed(clean[1].split())), "en", "s", 1), (None, " ".join(reversed(clean[0].split())), "en", "s", 1)], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    found = stages["decontamination"](spark, stages["language ID"](spark, docs.unionByName(more), data), data)
    left = [(r["doc_id"], r["text"]) for r in found.where("doc_id IS NULL OR doc_id < 0").collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(-5, " ".join(reversed(clean[1].split()))), (None, " ".join(reversed(clean[0].split())))]))
    spark.conf.set(corpus_pipeline.TOKENS_DIR, str(tmp_path))
    try:
        n = stages["token ids"](spark, found, data).count()
    finally:
        spark.conf.unset(corpus_pipeline.TOKENS_DIR)
    assert n == found.count() and len(os.listdir(tmp_path)) == 1


def test_thousands_of_languages(spark):
    """2,000 values: own columns for some, pools for the rest, at most COUNTS numbers, and the frequent ones are told."""
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]

    def text(i):
        rng = np.random.default_rng(i)
        words = ["".join(rng.choice(syllables, 3)) for _ in range(8)]
        return " ".join(rng.choice(words, 40))

    rows = [(n * 2_000 + i, text(i), f"lang{i:04d}") for i in range(2_000) for n in range(3 if i < 40 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(docs, own=40, pools=8)
    assert len(model.languages) == 48 and set(model.languages[:40]) == {f"lang{i:04d}" for i in range(40)} and set(model.languages) <= {r[2] for r in rows}
    got = langid.predict(docs.where("doc_id < 40"), model, ["doc_id"]).collect()
    assert sum(r["lang_pred"] == f"lang{r['doc_id']:04d}" for r in got) >= 36
    whole = langid.train(docs)
    assert len(whole.languages) <= langid.OWN + langid.POOLS and whole.log_p.size <= langid.COUNTS
    few = langid.predict(docs.where("doc_id < 20"), whole, ["doc_id"]).collect()
    assert len(few) == 20 and all(r["lang_pred"] in whole.languages and 0 < r["score"] <= 1 for r in few)


def test_identified_edges(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = langid.identified(docs.unionByName(docs))
    once = langid.identified(docs)
    assert kept.count() == 2 * once.count() and kept.columns == docs.columns
    assert langid.identified(docs.limit(0)).count() == 0
    assert langid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_size_of_what_is_broadcast(spark):
    """The distributions count, not the files that rates are computed from."""
    docs = spark.range(1_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.col("id").cast("string").alias("source"))
    _, _, size = mixing._rates(docs, None, 0.5, 1.0)
    assert size >= 1_000 * 8 * (mixing.MOST + 1)
