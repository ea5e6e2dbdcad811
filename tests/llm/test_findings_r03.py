"""What the review of round 3 found in language identification and in the pipeline."""

import tracemalloc

import numpy as np

from scriptorium.llm import langid, token_output


def test_every_language_of_more_than_a_model_holds_is_told(spark):
    """1,200 languages of a text each: none is pooled, so nearly every text gets its own, and mixtures are those of one model of all."""
    rng = np.random.default_rng(5)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    rows = [(i, " ".join(rng.choice(["".join(rng.choice(syllables, 3)) for _ in range(8)], 30)), f"lang{i:04d}") for i in range(langid.OWN + 200)]
    docs = spark.createDataFrame([*rows, (-1, "... 1", "wordless"), (-2, None, "textless")], "doc_id long, text string, lang string").repartition(4)
    model = langid.fitted(docs)
    asked = docs.where("doc_id % 8 = 0")
    got = {r["doc_id"]: r for r in langid.predict(asked, model, ["doc_id"]).collect()}
    assert len(model) == langid.OWN + 201 and len(got) == 150
    assert sum(r["lang_pred"] == f"lang{i:04d}" for i, r in got.items()) >= 145
    assert langid.identified(docs).count() > 0
    few, asked = docs.where("doc_id < 40"), asked.where("doc_id < 40")
    one = {r["doc_id"]: r["languages"] for r in langid.predict(asked, langid.train(few), ["doc_id"]).collect()}
    stored = langid.fitted(few, own=8)
    assert {r["doc_id"] for r in asked.collect()} == set(one) and len(stored) == len(langid.train(few))


def test_mixtures_among_all_languages_are_those_of_few(spark, data, monkeypatch):
    """A document alone among all languages has the mixture that it has among others, in memory and in a file."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(docs)
    stored = langid.fitted(docs, own=2)
    whole = stored.load()
    monkeypatch.setattr(langid, "CELLS", 1)
    kept = stored.load()
    assert isinstance(kept.log_p, np.memmap) and np.array_equal(kept.log_p, whole.log_p)
    texts = [r["text"] for r in docs.where("length(text) > 50").orderBy("doc_id").limit(40).collect()]
    texts += [a[:600] + " " + b[:400] for a, b in zip(texts[:10], texts[10:20], strict=True)]
    assert kept.languages == model.languages and np.allclose(kept.log_p, model.log_p, atol=1e-5)
    for i, text in enumerate(texts):
        monkeypatch.setattr(langid, "CELLS", i % 2 << 24)
        monkeypatch.setattr(langid, "COUNTS", 1 << (9 if i % 3 else 22))
        words = langid.words_letters(text.encode())
        want = langid.mixtures(langid.WordLikelihoods(model).of([words]), np.array([len(words)]))[0]
        assert np.allclose(langid.mixture_of_all(kept, words), want, atol=2e-3)


def test_a_kept_text_goes_to_a_worker_once(spark, data, monkeypatch):
    """What a worker gets has each text once, and rows are those of any size of slices, ids and empty texts included."""
    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(spark.createDataFrame([(None, None), (-1, "")], "doc_id long, text string"), allowMissingColumns=True)
    model = langid.train(docs)
    kept = langid.predict(docs, model, ["doc_id", "text", "source"])
    assert "_text" not in kept._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(repr, kept.collect()))
    monkeypatch.setattr(langid, "MOST_BYTES", 3_000)
    assert sorted(map(repr, langid.predict(docs, model, ["doc_id", "text", "source"]).collect())) == want and len(want) == docs.count()
    apart = langid.predict(docs, model, ["doc_id"]).select("doc_id", "lang_pred", "score")
    assert sorted(map(repr, apart.collect())) == sorted(map(repr, kept.select("doc_id", "lang_pred", "score").collect()))


def test_segments_take_few_bytes_an_id():
    """Encoding and decoding hold no more copies of a segment's ids than they need: 4 bytes an id each."""
    ids = (np.random.default_rng(1).zipf(1.3, 500_001) % 40_000).astype(np.uint32)

    def peak(call, *args):
        tracemalloc.start()
        value = call(*args)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return value, most / len(ids)

    data, most = peak(token_output.encode, ids, np.full(1, len(ids)))
    (back, _), again = peak(token_output.decode, data)
    assert np.array_equal(back, ids) and most < 15 and again < 20
