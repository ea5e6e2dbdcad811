"""Cross-tokenizer alignment by labels of bytes.

Two tokenizers cut the same bytes differently. Each byte gets a label: no token ends here, one of A does, one of B does, or both
do (``. a b x``). A regular expression cuts the labels into spans up to each ``x``; a span's tokens are a group, as many of A as it has
labels ``a`` and one more, and of B likewise. Each label but ``.`` ends a token of a pair whose bytes overlap, so there is one link for
each of them: the two tokens that the byte lies in. A task labels slices of many documents at once, as a document always ends with an ``x``.

Counting needs the whole corpus, and a document needs only its own pairs' counts. Documents are gathered into blocks of bounded text; a block is a
row with its documents' links as places in the block's list of distinct id pairs. Pairs are summed over blocks (:func:`pair_counts`),
joined back to the blocks' lists, and each block adds its documents' numbers up. What is shuffled are distinct pairs a block, and the blocks once; a
pair that is in every document is one row for each block.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored, tidy

#: Bytes of text in a block, and in a slice that is labelled at once.
BLOCK_BYTES, SLICE_BYTES = 8_000_000, 1_000_000
SPAN = re.compile(rb"[^x]*x")
LABELS = np.frombuffer(b".abx", np.uint8)
#: The fixed pattern by which byte-level tokenizers of this kind cut texts.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with longer words, or more white space than one character for each word and so many, go to the slower of two equal encoders, which is linear in them.
LONG_WORD, LONG_SPACE = 2_000, 500

BLOCKS = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "links binary, pairs array<long>, pair_n array<long>"
)
DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "doc_id long, groups array<struct<start: long, stop: long, a: array<int>, b: array<int>>>"


class Tokens(NamedTuple):
    """A tokenizer: a text to ids, and the bytes of each id. It has to give the bytes of a space and the text."""

    encode: Callable[[str], list[int]]
    token_bytes: list[bytes]


def byte_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def has_long_run(text: str) -> bool:
    """Whether a word, or a run of white space, may be long."""
    sizes = [*map(len, text.split())]
    return max(sizes, default=0) >= LONG_WORD or len(text) - sum(sizes) - len(sizes) >= LONG_SPACE


def byte_level(path: str) -> Tokens:
    """A byte-level tokenizer's file, for a space and the text. Strings of special tokens are plain text.

    Where ids above the bytes' are in the order of merges, ranks say the same as the file's merges, and texts without very long runs
    go to the encoder by ranks, which takes a fifth of the time; tests compare the two.
    """
    from tiktoken import Encoding
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    of = byte_characters()
    table = [bytes(of.get(c, 63) for c in tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())]

    def whole(text: str) -> list[int]:
        return tokenizer.encode(" " + text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    model, cut = settings["model"], settings["pre_tokenizer"] or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    plain = settings["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    if not plain or not merges or [model["vocab"][m] for m in merges] != list(range(256, 256 + len(merges))):
        return Tokens(whole, table)
    ranks = Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={table[i]: i for i in range(256 + len(merges))}, special_tokens={})
    return Tokens(lambda text: whole(text) if has_long_run(text) else ranks.encode_ordinary(" " + text), table)


def pieces(path: str) -> Tokens:
    """A sentence-piece model, which puts the space before the text itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return Tokens(model.encode, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)])


def tokens(path: str) -> Tokens:
    return pieces(path) if path.endswith(".model") else byte_level(path)


class Aligned(NamedTuple):
    """The alignment of a slice of documents, of those whose bytes both tokenizers give back; the others count as empty."""

    a: np.ndarray  # ids of A, of one document after another
    b: np.ndarray
    group_a: np.ndarray  # tokens of A in each group
    group_b: np.ndarray
    group_bytes: np.ndarray
    links: np.ndarray  # id of A << 32 | id of B
    doc_a: np.ndarray  # tokens of A in each document
    doc_b: np.ndarray
    doc_groups: np.ndarray
    doc_links: np.ndarray


def labels(a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """The label of each byte, from where tokens end; both tokenizers' last tokens end at the last byte."""
    ends = np.zeros(a_ends[-1] if len(a_ends) else 0, np.uint8)
    ends[a_ends - 1] = 1
    ends[b_ends - 1] += 2
    return LABELS[ends].tobytes()


class Aligner:
    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t.token_bytes]) for t in (a, b))
        numbers = lambda t, mark: np.array([f"{i}{mark}" for i in range(len(t.token_bytes))], object)
        self.a_text, self.b_text = {m: numbers(a, m) for m in ",|"}, {m: numbers(b, m) for m in ",;"}

    def slice(self, texts: list[str | None]) -> Aligned:
        a_ids, b_ids, sizes = [], [], []
        for text in texts:
            a, b, size = [], [], 0
            if text:
                raw = f" {text}".encode()
                a, b, size = self.a.encode(text), self.b.encode(text), len(raw)
                if b"".join(map(self.a.token_bytes.__getitem__, a)) != raw or b"".join(map(self.b.token_bytes.__getitem__, b)) != raw:
                    a, b, size = [], [], 0
            a_ids.append(np.array(a, np.int64))
            b_ids.append(np.array(b, np.int64))
            sizes.append(size)
        a, b, doc_ends = np.concatenate(a_ids), np.concatenate(b_ids), np.cumsum(sizes)
        marks = labels(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]))
        spans = SPAN.findall(marks)
        group_bytes = np.fromiter(map(len, spans), np.int64, len(spans))
        mark, last = np.frombuffer(marks, np.uint8), np.cumsum(group_bytes) - 1
        group_a, group_b = (np.diff(np.cumsum(mark == LABELS[i])[last], prepend=0) + 1 for i in (1, 2))  # a span's labels a, and b
        place = np.flatnonzero(mark != LABELS[0])
        mark = mark[place]
        ends_a, ends_b = mark != LABELS[2], mark != LABELS[1]
        links = a[np.cumsum(ends_a) - ends_a] << 32 | b[np.cumsum(ends_b) - ends_b]
        per_doc = lambda ends: np.diff(np.searchsorted(ends, doc_ends, side="right"), prepend=0)
        return Aligned(a, b, group_a, group_b, group_bytes, links, np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids]), per_doc(np.cumsum(group_bytes)), per_doc(place + 1))

    def digests(self, x: Aligned) -> list[str]:
        """SHA-256 of each document's groups as ``a1,a2|b1;a3|b2,b3``; nothing for one without tokens."""
        last_a, last_b = np.cumsum(x.group_a), np.cumsum(x.group_b)
        out = np.empty(len(x.a) + len(x.b), object)
        a, b = self.a_text[","][x.a], self.b_text[","][x.b]
        a[last_a - 1], b[last_b - 1] = self.a_text["|"][x.a[last_a - 1]], self.b_text[";"][x.b[last_b - 1]]
        out[np.arange(len(a)) + np.repeat(last_b - x.group_b, x.group_a)] = a
        out[np.arange(len(b)) + np.repeat(last_a, x.group_b)] = b
        found, at = [], 0
        for stop in np.cumsum(x.doc_a + x.doc_b).tolist():
            found.append(hashlib.sha256("".join(out[at:stop].tolist())[:-1].encode()).hexdigest() if stop > at else "")
            at = stop
        return found


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str | None], int]]:
    """Ids, texts and bytes of a batch in slices of about SLICE_BYTES. Bytes that aren't UTF-8 can't come back from tokens: no text."""
    ids, texts, size = [], [], 0
    for doc_id, raw in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
        raw = raw.as_py() or b""
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = None
        ids.append(doc_id.as_py())
        texts.append(text)
        size += len(raw)
        if size >= SLICE_BYTES:
            yield ids, texts, size
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, size


def block_row(number: int, slices: list[tuple[list, list[str], Aligned]]) -> pa.RecordBatch:
    """A block of aligned slices. Frequent pairs come first in its list, so places are small numbers and pack well."""
    pairs, place, times = np.unique(np.concatenate([x.links for _, _, x in slices]), return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    longs = pa.list_(pa.int64())
    sums = {"n_a": "doc_a", "n_b": "doc_b", "n_groups": "doc_groups", "n_links": "doc_links"}
    return pa.RecordBatch.from_pydict({
        "block": pa.array([number], pa.int64()), "doc_id": pa.array([[i for ids, _, _ in slices for i in ids]], longs),
        **{c: pa.array([np.concatenate([getattr(x, f) for _, _, x in slices]).astype(np.int64)], longs) for c, f in sums.items()},
        "groups_sha256": pa.array([[d for _, digests, _ in slices for d in digests]], pa.list_(pa.string())),
        "links": pa.array([zlib.compress(rank[place.reshape(-1)].tobytes(), 1)], pa.binary()), "pairs": pa.array([pairs[order]], longs), "pair_n": pa.array([times[order]], longs),
    })


def blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text) rows to blocks (BLOCKS), to be stored: a block's number is its task's and its own within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, size, number = Aligner(tokens(a_path), tokens(b_path)), [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts, n in texts_of(batch):
                found = aligner.slice(texts)
                held.append((ids, aligner.digests(found), found._replace(a=None, b=None, group_a=None, group_b=None, group_bytes=None)))
                size += n + 64 * len(ids)
                if size >= block_bytes:
                    yield block_row(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield block_row(number, held)

    return docs.mapInArrow(tidy(run), BLOCKS)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, n, best) of stored blocks: in how many links of the corpus an id pair is, and whether no pair of its B id is in more."""
    each = held.select(F.inline(F.arrays_zip("pairs", "pair_n"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_n").alias("n"))
    counts = stored(each.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B, of its vocabulary at most
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs`` (DOCS): numbers of tokens, groups and links, and what the corpus says of the links.

    A (a ``.json`` file of a byte-level tokenizer) encodes a space and the text, B (a ``.model`` of sentence pieces) the text, before which it
    puts a space itself; no special tokens. A group is what lies between two neighbouring places where tokens of both end. A link is a pair of an A
    and a B token whose bytes overlap, and its count the number of links in the whole corpus with the same two ids. n_best are the
    links with the highest count that any pair of their B id has, ties included; count_sum is the sum of the links' counts;
    groups_sha256 is the digest of ``a1,a2|b1;a3|b2,b3``, the groups' ids in order.

    Null and empty texts, and texts that either tokenizer's bytes don't give back, have no tokens: zeros and an empty string.
    Ids may be null or repeat, equal rows count each; an empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = stored(blocks(texts, a_path, b_path), "blocks")
    own = held.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    scores = own.join(pair_counts(held), "pair").select("of_block", "place", "n", "best")

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        links = np.frombuffer(zlib.decompress(block["links"][0].as_py()), np.int32)
        out = {c: block[c].combine_chunks().flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        stops = np.cumsum(out["n_links"].to_numpy())
        for name, column in (("n_best", "best"), ("count_sum", "n")):
            value = np.zeros(len(found), np.int64)
            value[found["place"].to_numpy()] = found[column].to_numpy(zero_copy_only=False).astype(np.int64)
            totals = np.concatenate([[0], np.cumsum(value[links])])[stops]
            out[name] = pa.array(np.diff(totals, prepend=0), pa.int64())
        return pa.table({c: out[c] for c in (x.split()[0] for x in DOCS.split(", "))})

    return held.drop("pairs", "pair_n").groupBy("block").cogroup(scores.groupBy("of_block")).applyInArrow(finish, DOCS)


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves, a row for each row of ``docs``: byte places (of a space and the text) and ids of either tokenizer.

    Texts without tokens have an empty list. Other rules as for :func:`alignment`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokens(a_path), tokens(b_path))
        lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
        for batch in batches:
            for ids, texts, _ in texts_of(batch):
                x = aligner.slice(texts)
                stop = np.cumsum(x.group_bytes)
                before = np.repeat(np.concatenate([[0], stop])[np.cumsum(x.doc_groups) - x.doc_groups], x.doc_groups)
                fields = [pa.array(stop - x.group_bytes - before), pa.array(stop - before), lists(x.group_a, pa.array(x.a, pa.int32())), lists(x.group_b, pa.array(x.b, pa.int32()))]
                groups = lists(x.doc_groups, pa.StructArray.from_arrays(fields, ["start", "stop", "a", "b"]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), groups], ["doc_id", "groups"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), GROUPS)
