"""Operators that SQL can't state, against plain statements of their rules, and edge cases of all."""

import hashlib
import html
import json
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, langid, media, quality, queries, shard, token_output
from scriptorium.llm.common import WordHashes, words_letters

from .test_llm_operators import EDGES, SCHEMA, docs, edges  # noqa: F401


# Media columns.


def payload_of(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 if raw else 576)


def test_media_of_edges(spark, edges, tmp_path):
    """Null, empty, very long and repeated texts, clashing columns: stored, read back, and put at their pages' places."""
    path = str(tmp_path / "media")
    media.text_images(edges).write.parquet(path)
    store = spark.read.parquet(path)
    pages = store.select("doc_id", "n_bytes", "html", F.lit("r").alias("row"), F.lit("k").alias("key"), F.lit("d").alias("digest"), F.lit("p").alias("piece"), F.lit("s").alias("kept"))
    keep = ["doc_id", "n_bytes", "row", "key", "digest", "piece", "kept"]
    got = media.resolved(media.sequences(pages, keep), keep, media.image_features(store)).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in got) == sorted((e[0] or 0, len((e[1] or "").encode())) for e in EDGES)
    assert all((r["row"], r["key"], r["digest"], r["piece"], r["kept"]) == ("r", "k", "d", "p", "s") for r in got)
    payloads = {(e[0], len((e[1] or "").encode())): payload_of(e[1]) for e in EDGES}
    for r in got:
        payload = payloads[r["doc_id"], r["n_bytes"]]
        text, image = r["pieces"]
        assert (text["kind"], image["kind"], image["position"]) == ("text", "media", 1)
        m = image["media"]
        assert (m["payload_bytes"], m["payload_sha256"], m["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert image["caption"] == f"{m['media_bytes']} bytes" and m["media_sha256"] == image["digest"]
        x = np.frombuffer(payload, np.uint8).astype(float)
        rows, mean, deviation, shares = m["feature"].split(";")
        assert int(rows) * 24 == len(payload) and int(mean) == int(100 * x.mean() + 1e-6) and abs(int(deviation) - 100 * x.std()) <= 1
        assert shares == ",".join(str(int(1000 * n) // len(x)) for n in ((x < 128).sum(), ((x >= 128) & (x < 255)).sum(), (x == 255).sum()))
    none = edges.limit(0)
    assert media.text_images(none).count() == 0 == media.sequences(pages.limit(0), keep).count()


def test_web_pages_become_sequences(spark, data):
    """Real pages, with an image set into each: text in order without hidden elements, the image resolved at its place."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    digest = F.sha2(F.col("page_id").cast("string").cast("binary"), 256)
    figure = F.concat(F.lit('</p><figure><img src="sha256:'), digest, F.lit('"><figcaption>Figure '), F.col("page_id").cast("string"), F.lit("</figcaption></figure><p>"))
    shown = pages.withColumn("html", F.regexp_replace("html", r"</p><p>", "</p>\n<p>")).withColumn("html", F.concat(F.col("html"), F.lit("<p>tail"), figure, F.lit("after")))
    store = pages.where("page_id % 3 <> 0").select(digest.alias("digest"), F.col("page_id").alias("of"))
    got = {r["page_id"]: r["pieces"] for r in media.resolved(media.sequences(shown, ["page_id", "url"]), ["page_id", "url"], store).collect()}
    rows = shown.collect()
    assert len(got) == len(rows)
    for r in rows:
        pieces = got[r["page_id"]]
        assert [p["position"] for p in pieces] == list(range(len(pieces)))
        image = next(p for p in pieces if p["kind"] == "media")
        assert image["caption"] == f"Figure {r['page_id']}" and (image["media"]["of"] if r["page_id"] % 3 else image["media"]) == (r["page_id"] if r["page_id"] % 3 else None)
        body = re.sub(r"(?s)<(script|style|head|title|noscript|template)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", r["html"])
        body = re.sub(r"(?s)<figcaption>.*?</figcaption>", " ", body)
        want = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert "".join(p["text"] or "" for p in pieces).replace(" ", "") == "".join(want).replace(" ", "")


# Token ids.


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_of_the_library(edges, name):
    """A tokenizer that isn't word by word gets whole texts."""
    from tokenizers import Tokenizer

    path = queries.vocabulary(name)
    t = Tokenizer.from_file(path)
    assert token_output.word_tokens(path).wordwise == (name == "word_bpe_49k.json")
    want = sorted(zlib.crc32(np.array([*t.encode(e[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for e in EDGES)
    assert sorted(r["ids_crc32"] for r in token_output.token_output(edges, path).collect()) == want


def test_settings_of_a_tokenizer():
    with open(queries.vocabulary()) as f:
        settings = json.load(f)
    assert token_output.is_wordwise(settings)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"truncation": {}}, {"added_tokens": [{"content": "the"}]}, {"model": settings["model"] | {"dropout": 0.1}}):
        assert not token_output.is_wordwise(settings | change)


def test_equal_rows_are_dealt_out(spark):
    """One row repeated: its copies go to several ranges, and the ids are those of all copies."""
    df = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text")).repartition(4)
    got = token_output.token_output(df, queries.vocabulary())
    rows = got.collect()
    assert len(rows) == 4000 and sorted(r["start"] for r in rows) == [i * rows[0]["n_tokens"] for i in range(4000)]


# Sharding.


def test_written_shards(spark, edges, tmp_path):
    """Null and repeated ids: no row is lost or doubled, and each is where the placement says."""
    path = str(tmp_path / "shards")
    wide = edges.withColumn("row", F.lit("r")).withColumn("slot", F.lit("old"))
    shard.write_shards(wide, path, 4, seed=3)
    back = spark.read.parquet(path).collect()
    want = sorted((r["doc_id"] or 0, r["size"], r["shard"], r["slot"]) for r in shard.shard_documents(edges, 4, 3).collect())
    key = lambda r: (r["doc_id"] or 0, len((r["text"] or "").encode()) + 1, r["shard"], r["slot"])
    equal = {k[:2] for k in map(key, back) if sum(k[:2] == key(r)[:2] for r in back) > 1}  # rows alike are interchangeable
    assert sorted(k for k in map(key, back) if k[:2] not in equal) == [w for w in want if w[:2] not in equal]
    assert sorted(map(key, back)) == want and all(r["row"] == "r" for r in back) and len(back) == len(EDGES)


# Language identification.


def mixture_plainly(text, model):
    """Language -> share of the chosen set, by expectation-maximisation word for word in plain numbers."""
    langs = range(len(model.languages))
    likelihoods = []
    for word in words_letters(text.encode()):
        padded = b" " + word + b" "
        codes = [(padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761 % 2**32 >> 16 for i in range(len(word))]
        log_p = [sum(float(model.log_p[c, k]) for c in codes) for k in langs]
        likelihoods.append([max(math.exp(x - max(log_p)), 1e-30) for x in log_p])
    n = len(likelihoods)

    def maximise(chosen):
        share = {k: 1 / len(chosen) for k in chosen}
        for _ in range(langid.ITERATIONS):
            total = dict.fromkeys(chosen, 0.0)
            for p in likelihoods:
                whole = sum(share[k] * p[k] for k in chosen)
                for k in chosen:
                    total[k] += share[k] * p[k] / whole
            share = {k: total[k] / n for k in chosen}
        return share, sum(math.log(max(sum(share[k] * p[k] for k in chosen), 1e-35)) for p in likelihoods)

    share, _ = maximise(list(langs))
    order = sorted(langs, key=lambda k: -share[k])
    best, score = {order[0]: 1.0}, sum(math.log(p[order[0]]) for p in likelihoods)
    for k in range(2, len(order) + 1):
        if share[order[k - 1]] * n <= 0.25:
            break
        part, fit = maximise(order[:k])
        if fit - 0.5 * (k - 1) * math.log(n) > score:
            best, score = part, fit - 0.5 * (k - 1) * math.log(n)
    return {model.languages[k]: x for k, x in best.items() if x > 0}


def test_language_mixtures_plainly(spark, docs):
    model = langid.train(docs)
    by = {}
    for r in docs.where("length(text) >= 200").orderBy("doc_id").collect():
        by.setdefault(r["lang"], []).append(r["text"][:900])
    en, fr, de, es = (by[k] for k in ("en", "fr", "de", "es"))
    texts = [en[0], fr[0], de[0], es[0], en[1] + " " + fr[1], f"{de[1]} {es[1]} {en[2]}", f"{en[3]} {fr[2]} {de[2]} {es[2]}", en[4] * 3 + fr[3][:40], "the", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(df, model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        want = mixture_plainly(text, model)
        found = {x["lang"]: x["share"] for x in got[i]["languages"]}
        assert set(found) == set(want) and all(abs(found[k] - want[k]) < 2e-3 for k in want), (i, found, want)
        assert got[i]["lang_pred"] == max(want, key=want.get) and abs(got[i]["score"] - max(want.values())) < 2e-3


def test_language_counts_plainly(spark, docs):
    model = langid.train(docs)
    counts = np.full((langid.BUCKETS, len(model.languages)), langid.SMOOTHING)
    for r in docs.collect():
        if r["lang"] is None or r["text"] is None:
            continue
        for word in words_letters(r["text"].encode()):
            padded = b" " + word + b" "
            for i in range(len(word)):
                counts[(padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761 % 2**32 >> 16, model.languages.index(r["lang"])] += 1
    assert np.allclose(model.log_p, np.log(counts / counts.sum(axis=0)), atol=1e-5)


@pytest.mark.parametrize("text", ["½ ²", "Ⅷ", "①", "٣ 12", "__ !", "\u0301", None, ""])
def test_no_letter_no_language(spark, docs, text):
    model = langid.train(docs)
    row = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, ["doc_id"]).first()
    assert (row["lang_pred"], row["score"], row["languages"]) == ("und", 0.0, [])


def test_language_of_nothing_and_of_many(spark, docs):
    assert langid.predict(docs.limit(0), langid.train(docs), ["doc_id"]).count() == 0
    many = spark.createDataFrame([(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in ("oka", "umi", "ewo")) * 30, f"l{i}") for i in range(60)], "doc_id long, text string, lang string")
    got = langid.predict(many, langid.train(many), ["doc_id"]).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id']}" for r in got) >= 57


# Quality.


class Plain:
    """The logistic view on a dense matrix, step by step as the module describes."""

    def __init__(self, size, penalty):
        self.w, self.b, self.penalty = np.zeros(size), 0.0, penalty

    def p(self, x):
        return quality.sigmoid(x @ self.w + self.b)

    def fit(self, x, y, weight, sizes, steps=60, others=None):
        weight = weight / weight.sum()
        start, start_b = self.w.copy(), self.b
        pull, pull_b, hold, share = np.zeros(len(self.w)), 0.0, np.zeros(len(self.w)), 0.0
        if others:
            gradient, bias, squares, share = others
            weight, pull, pull_b = weight * (1 - share), share * gradient, share * bias
            hold = share * np.sqrt(squares * squares.max() * max(1.0, sizes.mean()))
        curve = weight @ x**2 + 1e-6
        rate = 4.0 / (np.sqrt(curve * curve.max()) * max(1.0, np.sqrt(sizes.mean())))
        w, b, t = self.w, self.b, 1.0
        ahead, ahead_b = w, b
        for _ in range(steps):
            error = weight * (quality.sigmoid(x @ ahead + ahead_b) - y)
            step = ahead - rate * (error @ x + pull) + rate * hold / 4 * start
            new = np.sign(step) * np.maximum(0, np.abs(step) - rate * self.penalty) / (1 + rate * hold / 4)
            new_b = ahead_b - 2.0 * (error.sum() + pull_b + share / 4 * (ahead_b - start_b))
            t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
            ahead, ahead_b = new + (last - 1) / t * (new - w), new_b + (last - 1) / t * (new_b - b)
            w, b = new, new_b
        self.w, self.b = w, b


def test_quality_plainly(spark):
    """A refit on dense matrices, all unlabelled documents in one place: the same views and scores."""
    rng = np.random.default_rng(5)
    good, bad, both = "clear prose about rivers hills and old towns".split(), "buy cheap pills now click win cash".split(), "the of and to in".split()

    def row(i):
        y = i % 2
        words = [*rng.choice(good if y else bad, 6), *rng.choice(both, 5), *rng.choice(bad if y else good, 1 + (i % 3 == 0))]
        return i, " ".join(map(str, words)), "en" if i % 5 else None, f"s{y if i % 7 else 2}", len(" ".join(words))

    rows = [row(i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    got = {r["doc_id"]: (r["p_text"], r["p_meta"], r["score"]) for r in quality.scored(df, model).collect()}

    held_ids = {r["doc_id"] for r in labels.where(F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0).collect()}
    hashes = WordHashes()
    text, meta = np.zeros((400, quality.TEXT_SIZE)), np.zeros((400, quality.META_SIZE))
    sizes = np.zeros((400, 2))
    for i, t, lang, source, n in rows:
        index, value = quality.text_view(t.encode(), hashes)
        np.add.at(text[i], index, value)
        marks = quality.meta_view(source, lang, n, t.encode())
        np.add.at(meta[i], marks, 1.0)
        sizes[i] = len(index), len(marks)
    known = np.array([i for i in range(160) if i not in held_ids])
    held = np.array(sorted(held_ids))
    pool = np.arange(160, 400)
    y = np.arange(400) % 2 * 1.0
    a, b = Plain(quality.TEXT_SIZE, 4e-4), Plain(quality.META_SIZE, 1e-3)
    n = len(known)
    a.fit(text[known], y[known], np.ones(n), sizes[known, 0], 240)
    b.fit(meta[known], y[known], np.ones(n), sizes[known, 1])
    sure = lambda p: (p >= quality.CONFIDENT) | (p <= 1 - quality.CONFIDENT)
    for _ in range(quality.ROUNDS):
        p_a, p_b = a.p(text[pool]), b.p(meta[pool])
        taught, teaches = pool[sure(p_b)], pool[sure(p_a)]
        label_b, label_a = (p_b[sure(p_b)] > 0.5) * 1.0, (p_a[sure(p_a)] > 0.5) * 1.0
        if len(taught):
            error = p_a[sure(p_b)] - label_b
            mass = 0.5 * min(n, len(taught))
            a.fit(text[known], y[known], np.ones(n), sizes[known, 0], others=(error @ text[taught] / len(taught), error.mean(), (text[taught] ** 2).sum(0) / len(taught), mass / (n + mass)))
        tuples = {}
        for i, label in zip(teaches, label_a, strict=True):
            tuples.setdefault((tuple(np.flatnonzero(meta[i])), label), [0, i])[0] += 1
        count, of = np.array([c for c, _ in tuples.values()], float), np.array([i for _, i in tuples.values()], int)
        x = np.vstack([meta[known], meta[of]]) if len(of) else meta[known]
        b.fit(x, np.append(y[known], [label for _, label in tuples]), np.append(np.ones(n), count * 0.5 * min(1.0, n / max(1.0, count.sum()))), np.append(sizes[known, 1], sizes[of, 1]) if len(of) else sizes[known, 1])
    z = [text[held] @ a.w + a.b, meta[held] @ b.w + b.b]
    scale = [quality.calibrate(v[:, None], y[held]) for v in z]
    both_w = quality.calibrate(np.column_stack([s[0] * v + s[1] for s, v in zip(scale, z, strict=True)]), y[held])
    za, zb = scale[0][0] * (text @ a.w + a.b) + scale[0][1], scale[1][0] * (meta @ b.w + b.b) + scale[1][1]
    want = np.column_stack([quality.sigmoid(za), quality.sigmoid(zb), quality.sigmoid(both_w[0] * za + both_w[1] * zb + both_w[2])])
    assert np.abs(np.array([got[i] for i in range(400)]) - want).max() < 5e-3
    assert want[:, 2].min() < 0.1 and want[:, 2].max() > 0.9


def test_quality_of_edges(spark, edges):
    """Null and repeated ids, empty tables, ids that repeat often in the labelled rows."""
    labels = spark.createDataFrame([(i, (i or 0) % 2, 0) for i in (1, 2, 3, 4, 5, 6, None)], "doc_id long, quality int, toxic int")
    model = quality.train(edges, labels)
    assert quality.scored(edges, model).where("score BETWEEN 0 AND 1").count() == len(EDGES)
    assert quality.scored(edges.limit(0), model).count() == 0
    assert {r["score"] for r in quality.scored(edges, quality.train(edges.limit(0), labels)).collect()} == {0.5}
    many = edges.where("doc_id = 4").crossJoin(spark.range(500))
    assert quality.labelled(many, quality.marks_of(labels), 12_000).count() == 1
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    marks = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    whole = quality.bounded(quality.featured(quality.labelled(rows, quality.marks_of(marks), 12_000)), 1 << 30).count()
    assert whole == 400 and 0 < quality.bounded(quality.featured(quality.labelled(rows, quality.marks_of(marks), 12_000)), 20_000).count() < 200


# Chat.


def test_long_conversations(spark):
    """Very long turns, many turns, and snapshots of them."""
    long = "word " * 200_000
    logs = {1: [(i, "u", f"t{i}") for i in range(3000)], 2: [(i, "u", f"t{i}") for i in range(2999)], 3: [(0, "u", long)], 4: [(0, "u", long), (1, "a", long + "x")], 5: [(0, "u", long + " ")]}
    df = spark.createDataFrame([(c, *t) for c, turns in logs.items() for t in turns], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.rendered(df).collect()}
    assert set(got) == {1, 4, 5} and got[1]["n_turns"] == 3000
    assert got[4]["rendered"] == f"<|im_start|>u\n{long}<|im_end|>\n<|im_start|>a\n{long}x<|im_end|>\n"


def test_turns_without_conversation(spark, tmp_path):
    """Each is a conversation of one turn, snapshots and copies included; the SQL says the same."""
    rows = [(None, 1, "u", "a"), (None, 5, "u", "a"), (None, 2, "u", "b"), (1, 0, "u", "b"), (2, 0, "u", "c"), (2, 1, "a", "d"), (None, 0, "u", "c"), (None, 0, None, None), (3, None, "u", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(str, ((r["conv_id"], r["n_turns"], r["copies"], r["rendered"]) for r in chat.rendered(df).collect())))
    con = duckdb.connect()
    con.register("c", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM c")
    assert got == sorted(map(str, con.execute(f"SELECT conv_id, n_turns, copies, rendered FROM ({queries.CHAT_SQL})").fetchall()))
    assert len(got) == 5
