"""The training-data operators against brute force, SQL, round trips and held-out labels, and in edge cases."""

import binascii
import hashlib
import math
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, decontaminate, langid, license_scan, media, mixing, neardup, quality, queries, shard, token_output

LOW = str.maketrans(license_scan.UPPER, license_scan.LOWER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate string, component_id string"
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
EDGES = [
    (1, None, None, None, None, "clash", "x"), (2, "", "en", "a", 0, "clash", "x"), (3, "  \t\n", "en", "a", 4, "c", "x"), (4, "All rights reserved. CC-BY cc by", "en", None, 10, "c", "x"),
    (4, "All rights reserved. CC-BY cc by", "en", None, 10, "c", "x"), (None, "no id here at all", "fr", "b", 3, "c", "x"), (5, LONG, "en", "a", len(LONG), "c", "x"),
    (6, LONG + " tail", "en", "a", len(LONG), "c", "x"), (7, "日本 é <|endoftext|> \x1c x don't", "xx", "b", 9, "c", "x"), (8, "12 34 !!", "en", "b", 8, "c", "x"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def sql_rows(data, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rel = con.execute(sql)
    return [d[0] for d in rel.description], rel.fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    columns, want = sql_rows(data, queries.oracle_sql()[name])
    got = queries.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    tidy = lambda rows: sorted(repr([float(f"{v:.9g}") if isinstance(v, float) else v for v in r]) for r in rows)
    assert tidy(got.select(*columns).collect()) == tidy(want)


# License scan.


def test_license_edges(edges):
    rows = {(r["doc_id"], r["n_words"]): r for r in license_scan.report(license_scan.scan(edges)).collect()}
    assert rows[1, 0]["labels"] == "" and rows[1, 0]["first_word"] is None
    found = rows[4, 7]
    assert (found["n_base"], found["first_word"], found["last_word"], found["base_labels"], found["score"]) == (3, 0, 5, "cc-by,reserved", 1.0)
    assert license_scan.scan(edges).count() == len(EDGES) and license_scan.scan(edges.limit(0)).count() == 0


# Media.


def test_pages_and_captions():
    html = '<title>no</title><p>A &amp; b<figure><img src="x.png" alt="alt"><figcaption>Cap</figcaption></figure>tail<script>var x="</p>"</script><img src="SHA256:zz" alt=" two  words ">'
    got = [(p["kind"], p["text"] or p["src"], p["caption"]) for p in media.page_pieces(html)]
    assert got == [("text", "A & b", None), ("media", "x.png", "Cap"), ("text", "tail", None), ("media", "SHA256:zz", "two words")]
    assert media.page_pieces(None) == [] == media.page_pieces("")


def test_payloads_stay_aligned(spark):
    a, b = "a" * 64, "b" * 64
    pages = spark.createDataFrame([(1, f'<p>x</p><img src="sha256:{b}" alt="B"><p>y</p><img src="sha256:{a}" alt="A"><img src="u.png">'), (1, None), (2, f'<img src="sha256:{"c" * 64}">')], "page_id long, html string")
    store = spark.createDataFrame([(a, 10), (a, 10), (b, 20), (None, 1)], "digest string, size int")
    got = media.resolved(media.sequences(pages, ["page_id"]), ["page_id"], store).collect()
    assert len(got) == 3
    full = next(r for r in got if r["page_id"] == 1 and r["pieces"])
    assert [(p["position"], p["caption"], p["media"]["size"] if p["media"] else None) for p in full["pieces"]] == [(0, None, None), (1, "B", 20), (2, None, None), (3, "A", 10), (4, None, None)]


def test_media_query_against_python(spark, data, docs):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = queries.op2_media_columns(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    with pytest.raises(ValueError):
        media.from_pgm(b"P5\n24 24\n255\nshort")


# Token ids.


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 5000, 70_000])
def test_segment_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.002, n), 49_407)
    data = token_output.encode(ids, np.array([n]))
    back, lengths = token_output.decode(data)
    assert (back == ids).all() and lengths.tolist() == [n]
    if n > 2 * 32_768:
        assert (token_output.decode(data, [1])[0] == ids[32_768:65_536]).all()
    if n:
        broken = bytearray(data)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            token_output.decode(bytes(broken))


def test_scaled_frequencies():
    counts = np.array([1.0] * 70_000 + [1e9])
    freq = token_output.scaled(counts, 18)
    assert freq.sum() == 1 << 18 and freq.min() == 1


def test_tokens_against_the_library(spark, edges, docs, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    both = docs.select("doc_id", "text").unionByName(edges.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    rows = both.collect()
    want, start = {}, 0
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.setdefault(r["doc_id"], []).append((start, len(ids), binascii.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = {}
    for r in token_output.token_output(both, queries.vocabulary()).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_output.token_output(both.limit(0), queries.vocabulary()).count() == 0


def test_small_segments_and_ids(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    token_output.write_token_ids(docs, path, queries.vocabulary(), segment_ids=500, slice_bytes=2000)
    segments = token_output.read_segments(spark, path)
    index = {r["doc_id"]: r for r in token_output.document_index(segments).collect()}
    assert segments.count() > 1 and sorted(r["start"] for r in index.values())[0] == 0
    for r in token_output.read_token_ids(segments).collect():
        assert len(r["ids"]) == index[r["doc_id"]]["n_tokens"] and r["ids"][-1] == 1


# Decontamination.


def test_contained_edges(spark, edges):
    items = spark.createDataFrame([(1, "word1 and word2 and word3 and word4 and"), (2, "ALL rights"), (3, None), (4, "absent words that no document has"), (None, "12 34")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(edges, items).collect()}
    assert got == {(5, 1), (6, 1), (4, 2), (8, None)}
    assert decontaminate.contained(edges.limit(0), items).count() == 0 == decontaminate.contained(edges, items.limit(0)).count()


def test_contained_in_blocks(docs, spark, data):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    whole = decontaminate.contained(docs, items)
    assert decontaminate.contained(docs, items, block_shingles=2000).exceptAll(whole).count() == 0


def test_sketches_miss_nothing():
    for size in range(1, 300):
        need = -(-80 * size // 100)
        assert decontaminate.sketch_length(size, 80) >= size - need + 1 or decontaminate.sketch_length(size, 80) == size


# Sharding.


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1009, 4099])
def test_permutation(n):
    places = [shard.place(i, n, 7, 5) for i in range(n)]
    assert sorted(s + 7 * t for s, t in places) == list(range(n))


def test_shards(edges, docs):
    rows = shard.shard_documents(docs, 16, 3).collect()
    n = len(rows)
    assert sorted(r["row_number"] for r in rows) == list(range(n))
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["row_number"])] == sorted(r["doc_id"] for r in rows)
    assert all(shard.place(r["row_number"], n, 16, 3) == (r["shard"], r["slot"]) for r in rows)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    again = shard.shard_documents(docs.repartition(7), 16, 3).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}
    small = shard.shard_documents(edges, 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in small) == sorted((i % 4, i // 4) for i in range(len(EDGES)))
    assert shard.shard_documents(edges.limit(0)).count() == 0


# Language identification.


def test_language_held_out(spark, data, docs):
    rows = {r["doc_id"]: r for r in queries.op6_language_id(spark, data).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in rows if rows[i]["held_out"]} == set(held)
    assert np.mean([rows[i]["lang_pred"] == lang[i] for i in held]) > 0.95


def test_language_edges_and_mixture(edges, docs):
    model = langid.train(docs)
    rows = langid.predict(edges, model, ["doc_id", "text"]).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        letter = any(unicodedata.category(c).startswith("L") for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letter and 0 <= r["score"] <= 1
    by = {}
    for r in docs.where("length(text) > 400").collect():
        by.setdefault(r["lang"], r["text"][:400])
    mixed = docs.sparkSession.createDataFrame([(1, by["en"] + " " + by["fr"])], "doc_id long, text string")
    found = langid.predict(mixed, model, ["doc_id"]).first()["languages"]
    assert {x["lang"] for x in found} == {"en", "fr"} and abs(found[0]["share"] - 0.5) < 0.15
    assert langid.predict(edges, langid.train(docs.limit(0)), ["doc_id"]).where("lang_pred <> 'und'").count() == 0


# Mixing.


def test_mixing_against_python(edges, docs):
    both = docs.unionByName(edges.select(*docs.columns).where("doc_id <> 4 OR doc_id IS NULL").withColumn("doc_id", F.col("doc_id") + 10**6))
    weights = {"src0": 100.0, "src1": 1.0, "a": 2.0}
    rate = {r["source"]: r["rate"] for r in mixing.rates(both, weights).collect()}
    assert max(rate.values()) > mixing.PART and rate["src2"] == 0 and rate[None] == 0

    def count(key, lam):
        parts = max(1, math.ceil(lam / 16))
        total = 0
        for i in range(1, parts + 1):
            u = (int(hashlib.md5(f"9:{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = c = math.exp(-lam / parts)
            k = 0
            while c <= u and k < 96:
                k += 1
                p *= lam / parts / k
                c += p
                total += 1
        return total

    want = {r["doc_id"]: count(r["doc_id"] if r["doc_id"] is not None else hashlib.md5(r["text"].encode()).hexdigest(), rate[r["source"]]) for r in both.collect()}
    out = mixing.mixed(both, weights, seed=9).collect()
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert [r["shuffle_key"] for r in out] == sorted(r["shuffle_key"] for r in out)
    assert mixing.mixed(edges.limit(0)).count() == 0 and "component_id" in mixing.mixed(edges).columns


@pytest.mark.parametrize("limit", [mixing.BROADCAST_BYTES, 0])
def test_mixing_leaves_columns_alone(spark, docs, edges, monkeypatch, limit):
    """Columns with any name come out as they went in, ties keep their rows, and sources beyond the broadcast give the same."""
    odd = ["_u", "_count", "_cdf", "_parts", "_source", "doc", "key", "draw", "of", "salt"]
    wide = edges.select(*docs.columns, *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in odd])
    want = {tuple(r)[:2]: tuple(r) for r in wide.collect()}
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", limit)
    out = mixing.mixed(wide, {"a": 1.0, "b": 3.0}, seed=2)
    assert out.columns == [*wide.columns, "rate", "copy", "shuffle_key"]
    rows = out.collect()
    assert rows and all(tuple(r)[: len(wide.columns)] == want[tuple(r)[:2]] for r in rows)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 1 << 40)
    assert sorted(r["shuffle_key"] for r in mixing.mixed(wide, {"a": 1.0, "b": 3.0}, seed=2).collect()) == sorted(r["shuffle_key"] for r in rows)


# Chat.


def test_snapshots(spark):
    turns = [(1, "u", "a"), (2, "a", "b"), (3, "u", "c")]
    logs = [(1, turns[:1]), (2, turns[:2]), (3, turns), (4, turns), (5, [(1, "u", "a"), (2, "a", "x")]), (6, [(1, None, None)]), (None, [(1, "u", "zz"), (1, "u", "zz")])]
    rows = [(c, t, r, x, "clash") for c, ts in logs for t, r, x in ts]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["rendered"]) for r in chat.rendered(df).collect()}
    assert set(got) == {3, 5, 6, None} and got[3][:2] == (3, 2)
    assert got[None] == (1, 2, "<|im_start|>u\nzz<|im_end|>\n") and got[6][2] == "<|im_start|>\n<|im_end|>\n"
    assert chat.rendered(df.limit(0)).count() == 0


# Quality.


def test_quality_held_out(spark, edges):
    folder = "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn from
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    test = F.pmod(F.xxhash64(F.lit("t"), "doc_id"), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~test))
    rows = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    held = labels.where(test).collect()
    right = [rows[r["doc_id"]]["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in held]
    assert np.mean(right) > 0.85
    assert quality.scored(edges, model).where("score BETWEEN 0 AND 1").count() == len(EDGES)
    none = quality.train(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.scored(edges, none).collect()} == {0.5}


# Near-duplicates.


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ids = sorted(sets)
    for j, a in enumerate(ids):
        for b in ids[:j]:
            if sets[a] and sets[b] and (both := len(sets[a] & sets[b])) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, docs, k, percent):
    rng = random.Random(k)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = rows[0][1].split()[:120]
    for i in range(150):  # a group around one text, from equal to too far
        own = list(words)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(40)}"
        rows.append((10**6 + i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, k, percent).collect()}
    assert got == components(rows, k, percent)


def test_near_duplicate_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 60)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if rng.random() > 0.04 else f"x{rng.randrange(20)}" for w in base)) for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == components(rows, 2, 80)


def test_near_duplicate_edges(edges):
    rows = neardup.near_duplicates(edges, 3, 85).collect()
    assert len(rows) == len(EDGES)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[3]["kept"]
    assert by[5]["component_id"] == by[6]["component_id"] == 5 and not by[6]["kept"] and by[None]["component_id"] is None and by[None]["kept"]
    kept = neardup.deduplicated(edges, 3, 85).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert neardup.near_duplicates(edges.limit(0)).count() == 0 == neardup.deduplicated(edges.limit(0)).count()


def test_repeated_ids_with_other_texts_stay(spark):
    """Rows of one id and different texts are different documents: only those of a linked text go."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "x"), (5, a + " more", "x"), (5, b, "x"), (5, b, "y"), (7, b + " tail", "x"), (9, c, "x"), (9, c, "y"), (None, a, "x"), (4, "", "x"), (4, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc string")
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got[5, 59] == (1, False) and got[5, 58] == (5, True) and got[7, 59] == (5, False) and got[9, 58] == (9, True) and got[None, 58] == (None, True)
    kept = neardup.deduplicated(df, 3, 85)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(1, a), (5, b), (9, c), (0, a), (4, "")])


def test_forest():
    xs, ys = neardup.forest([1, 2, 3, 1], [2, 3, 1, 4])
    assert len(xs) == 3
