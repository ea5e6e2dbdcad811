"""Alignment against a plain statement of its rules: whole texts through the libraries, all pairs of tokens, one dict for the corpus."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from scriptorium.llm import alignment, queries

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "Hello world", "  two  spaces\n\n  and lines \t\tx ", "it's they'll don't", "trailing space ", "naïve café é", "日本語のテキスト と words", "\U0001f600\U0001f468‍\U0001f469 end",
    "a▁b", "good words ▁ bad", "<|endoftext|> <s> </s> <0x41> <unk>", "\x1c \x1c  x\x85 y　 z  w", "x" * 3000, "a" + " " * 900 + "b", "=" * 1999, "supercalifragilistic " * 400, "1234567 89,001 3.14\r\n", "ﬁ ① Å ½", "\x00 null \x7f",
]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def whole(libraries, text):
    """(a ids, a bytes), (b ids, b bytes) of a text, from the libraries alone."""
    a, b = libraries
    chars = alignment.byte_characters()
    e = a.encode(" " + text, add_special_tokens=False)
    ids = b.encode(text)
    return (e.ids, [bytes(chars[c] for c in t) for t in e.tokens]), (ids, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids)])


def plain(libraries, texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    docs, count = [], defaultdict(int)
    for text in texts:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            (a_ids, a), (b_ids, b) = whole(libraries, text)
            if b"".join(a) == b"".join(b) == (" " + text).encode():
                n_a, n_b = len(a), len(b)
                spans = []
                for tokens in (a, b):
                    at, out = 0, []
                    for t in tokens:
                        out.append((at, at := at + len(t)))
                    spans.append(out)
                common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                low = 0
                for high in common:
                    groups.append(",".join(str(i) for i, (s, e) in zip(a_ids, spans[0]) if low <= s < high) + "|" + ",".join(str(i) for i, (s, e) in zip(b_ids, spans[1]) if low <= s < high))
                    low = high
                links = [(i, j) for i, (s, e) in zip(a_ids, spans[0]) for j, (t, f) in zip(b_ids, spans[1]) if s < f and t < e]
        for link in links:
            count[link] += 1
        docs.append((n_a, n_b, groups, links))
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [
        (n_a, n_b, len(g), len(x), sum(count[i, j] == most[j] for i, j in x), sum(count[l] for l in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for n_a, n_b, g, x in docs
    ]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_worked_example():
    a, b = [b" to", b"ken", b"s"], [b" token", b"s"]
    assert alignment.labels(np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])) == b"..a..xx"
    own = alignment.Aligner(alignment.Tokens(lambda _: [1, 2, 3], [b"", *a]), alignment.Tokens(lambda _: [4, 5], [b""] * 4 + b))
    got = own.slice(["tokens", "other", None, "tokens"])
    assert got.links.tolist() == 2 * [1 << 32 | 4, 2 << 32 | 4, 3 << 32 | 5]
    assert (got.doc_groups.tolist(), got.doc_links.tolist(), got.doc_a.tolist()) == ([2, 0, 0, 2], [3, 0, 0, 3], [3, 0, 0, 3])
    digest = hashlib.sha256(b"1,2|4;3|5").hexdigest()
    assert own.digests(got) == [digest, "", "", digest]


@settings(deadline=None, max_examples=150)
@given(st.text(st.sampled_from("ab 's\n\t\x1c\u00e9\u8a9e0.\u3000eion\U0001f600"), max_size=60) | st.text(max_size=30) | st.text("aAhs", max_size=900))
def test_ranks_give_the_ids_of_the_file(libraries, text):
    byte_level = LOADED.setdefault(0, alignment.tokens(A) if 0 not in LOADED else None)
    assert byte_level.encode(text) == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_ranks_give_the_ids_of_the_file_in_documents(spark, data, libraries):
    byte_level = alignment.tokens(A)
    for row in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        assert byte_level.encode(row["text"] or "") == libraries[0].encode(" " + (row["text"] or ""), add_special_tokens=False).ids


LOADED: dict = {}


@pytest.mark.parametrize("block_bytes", [1, 8_000_000])
def test_rows_against_brute_force(spark, libraries, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment.blocks, "__defaults__", (block_bytes,))
    monkeypatch.setattr(alignment, "SLICE_BYTES", min(block_bytes, 1_000_000))
    texts = TEXTS + ["Hello world", "Hello world"]
    rows = [(None if i == 5 else i // 2, t, "x", i) for i, t in enumerate(texts)]  # ids repeat, one is null; other columns clash
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pair int").repartition(3)
    got = alignment.alignment(docs, A, B)
    want = plain(libraries, texts)
    assert sorted((str(r["doc_id"]), *[r[c] for c in NAMES]) for r in got.collect()) == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))


def test_groups_cover_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    b_bytes = alignment.tokens(B).token_bytes
    for row in alignment.token_groups(docs, A, B).collect():
        text = (" " + (TEXTS[row["doc_id"]] or "")).encode()
        at = 0
        for g in row["groups"]:
            assert g["start"] == at and b"".join(b_bytes[i] for i in g["b"]) == text[at : g["stop"]]
            at = g["stop"]
        assert at in (0, len(text))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(empty, A, B).count() == 0 and alignment.token_groups(empty, A, B).count() == 0


def test_query_against_brute_force(spark, data, libraries):
    rows = [r for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip([r["doc_id"] for r in rows], plain_fast(libraries, [r["text"] for r in rows]), strict=True))
    got = queries.queries()["op13_tokenizer_alignment"](spark, data).collect()
    assert {r["doc_id"]: tuple(r[c] for c in NAMES) for r in got} == want and len(got) == len(rows)


def plain_fast(libraries, texts):
    """:func:`plain` for long texts: each document in groups of its common ends, whose links are all overlapping pairs."""
    docs, count = [], defaultdict(int)
    for text in texts:
        links, groups, n_a, n_b = [], [], 0, 0
        (a_ids, a), (b_ids, b) = whole(libraries, text) if text else (([], []), ([], []))
        if text and b"".join(a) == b"".join(b) == (" " + text).encode():
            n_a, n_b = len(a), len(b)
            i = j = end_a = end_b = 0
            own_a, own_b = [], []
            while i < n_a or j < n_b:
                if end_a <= end_b:
                    own_a.append((a_ids[i], end_a, end_a + len(a[i])))
                    end_a, i = end_a + len(a[i]), i + 1
                else:
                    own_b.append((b_ids[j], end_b, end_b + len(b[j])))
                    end_b, j = end_b + len(b[j]), j + 1
                if end_a == end_b:
                    groups.append(",".join(str(x[0]) for x in own_a) + "|" + ",".join(str(x[0]) for x in own_b))
                    links += [(x, y) for x, s, e in own_a for y, t, f in own_b if s < f and t < e]
                    own_a, own_b = [], []
        for link in links:
            count[link] += 1
        docs.append((n_a, n_b, groups, links))
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(n_a, n_b, len(g), len(x), sum(count[l] == most[l[1]] for l in x), sum(count[l] for l in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, x in docs]
