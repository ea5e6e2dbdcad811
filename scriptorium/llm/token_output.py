"""Token-ID output: a static range asymmetric numeral system (rANS) container for token ids.

Documents are dealt into partitions by range of id and sorted, tokenized, and written as segments of
about four million ids. A segment is one self-contained binary value:

========  =====================================================================================
magic     ``b"RNS1"``
header    little-endian: ids ``q``, blocks ``I``, lanes ``I``, steps ``I``, scale bits ``I``,
          bytes of the table ``I``, of the lengths ``I``, checksum of the rest ``I``
table     zlib: uint32 count of symbols, uint32 gaps between symbols, uint32 frequencies
lengths   zlib: uint32 ids of each document, end id included
starts    uint64 for each block and lane: checkpoints, the coder's states where decoding begins
offsets   uint32 for each block and one more: the block's first word in ``words``
checks    uint32 for each block: CRC-32 of its ids as little-endian uint32
words     uint32 payload
========  =====================================================================================

All blocks of a segment share its frequency table, scaled to a power of two. A block interleaves its
lanes in one stream of words: lane k holds the ids at places k, k + lanes, ... Checkpoints make the
blocks independent, so any of them can be decoded alone and all of them at once; here NumPy decodes
one id of every lane of every block at a time.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import scratch_path, tidy

MAGIC = b"RNS1"
HEADER = struct.Struct("<qIIIIIII")
LANES, STEPS = 32, 1024
#: Lower end of the coder's state; states are below 2**63 and words have 32 bits.
LOW = np.uint64(1 << 31)
SEGMENT_IDS = 4_000_000
#: Texts go to the tokenizer in slices of about so many bytes.
SLICE_BYTES = 6_000_000


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**bits."""
    total = 1 << bits
    freq = np.maximum(1, np.floor(counts * (total / counts.sum())).astype(np.int64))
    order = np.argsort(-freq, kind="stable")
    left = total - int(freq.sum())
    if left > 0:
        freq[order[0]] += left
    for i in order:
        if left >= 0:
            break
        take = min(-left, int(freq[i]) - 1)
        freq[i] -= take
        left += take
    return freq


def _counts(ids: np.ndarray) -> np.ndarray:
    """How often each id occurs; in pieces, as NumPy counts a copy in long."""
    counts = np.zeros(int(ids.max()) + 1, np.int64)
    for at in range(0, len(ids), 1 << 18):
        piece = np.bincount(ids[at : at + (1 << 18)])
        counts[: len(piece)] += piece
    return counts


def encode(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A segment of ``ids``; ``lengths`` are the documents' numbers of ids. No ids: an empty segment."""
    n = len(ids)
    packed_lengths = zlib.compress(lengths.astype("<u4").tobytes(), 1)
    if n == 0:
        body = packed_lengths
        return MAGIC + HEADER.pack(0, 0, 0, 0, 0, 0, len(packed_lengths), zlib.crc32(body)) + body
    counts = _counts(ids)
    symbols = np.flatnonzero(counts)
    bits = max(16, int(len(symbols)).bit_length() + 2)
    freq = scaled(counts[symbols].astype(np.float64), bits)
    low = np.zeros(len(counts), np.uint64)
    wide = np.zeros(len(counts), np.uint64)
    wide[symbols] = freq.astype(np.uint64)
    low[symbols] = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)

    steps = min(STEPS, -(-n // LANES))
    blocks = -(-n // (steps * LANES))
    grid = np.empty((steps, blocks, LANES), np.int32)
    whole = n // (steps * LANES)
    grid[:, :whole] = ids[: whole * steps * LANES].reshape(whole, steps, LANES).swapaxes(0, 1)
    if whole < blocks:  # the last block is padded
        last = np.full(steps * LANES, symbols[np.argmax(freq)], np.int32)
        last[: n - whole * steps * LANES] = ids[whole * steps * LANES :]
        grid[:, whole] = last.reshape(steps, LANES)
    grid = grid.reshape(steps, -1)
    state = np.full(blocks * LANES, LOW, np.uint64)
    shift, scale, word = np.uint64(63 - bits), np.uint64(bits), np.uint64(32)
    words: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    q = np.empty_like(state)
    for row in grid[::-1]:
        f = wide.take(row)
        full = np.flatnonzero(state >= f << shift)
        overflow = state.take(full)
        words.append(overflow.astype(np.uint32))
        owners.append((full // LANES).astype(np.int32))
        state[full] = overflow >> word
        np.floor_divide(state, f, out=q)
        f *= q
        state -= f
        state += low.take(row)
        q <<= scale
        state += q
    del grid
    owner, stream = np.concatenate(owners[::-1]), np.concatenate(words[::-1])
    del owners, words
    stream = stream[np.argsort(owner, kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=blocks))])
    as_bytes = ids.astype("<u4", copy=False)
    checks = [zlib.crc32(as_bytes[i : i + steps * LANES]) for i in range(0, n, steps * LANES)]
    table = zlib.compress(
        struct.pack("<I", len(symbols)) + np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1
    )
    body = b"".join([
        table, packed_lengths, state.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(),
        np.array(checks, "<u4").tobytes(), stream.astype("<u4").tobytes(),
    ])
    return MAGIC + HEADER.pack(n, blocks, LANES, steps, bits, len(table), len(packed_lengths), zlib.crc32(body)) + body


def decode(data: bytes, only: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of a segment, or the ids of the blocks ``only``; ValueError where a checksum differs."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n, blocks, lanes, steps, bits, n_table, n_lengths, check = HEADER.unpack_from(data, 4)
    view = memoryview(data)[4 + HEADER.size :]
    if zlib.crc32(view) != check:
        raise ValueError("the segment's checksum differs")
    lengths = np.frombuffer(zlib.decompress(view[n_table : n_table + n_lengths]), "<u4").astype(np.int64)
    if n == 0:
        return np.empty(0, np.int64), lengths
    table = zlib.decompress(view[:n_table])
    (m,) = struct.unpack_from("<I", table)
    symbols = np.cumsum(np.frombuffer(table, "<u4", m, 4), dtype=np.uint32)
    freq = np.frombuffer(table, "<u4", m, 4 + 4 * m).astype(np.int64)
    at = n_table + n_lengths
    state = np.frombuffer(view, "<u8", blocks * lanes, at).reshape(blocks, lanes).astype(np.uint64)
    at += 8 * blocks * lanes
    offsets = np.frombuffer(view, "<u4", blocks + 1, at).astype(np.int64)
    at += 4 * (blocks + 1)
    checks = np.frombuffer(view, "<u4", blocks, at)
    stream = np.frombuffer(view, "<u4", int(offsets[-1]), at + 4 * blocks).astype(np.uint64)
    chosen = np.arange(blocks) if only is None else np.asarray(only)
    state, ptr = np.ascontiguousarray(state[chosen]).reshape(-1), offsets[chosen].copy()
    of_slot = np.repeat(np.arange(m, dtype=np.int32), freq)
    wide, low = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    mask, scale, word = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32)
    out = np.empty((steps, len(state)), np.int32)
    for row in out:
        slot = state & mask
        of_slot.take(slot.view(np.int64), out=row, mode="clip")
        state >>= scale
        state *= wide.take(row)
        slot -= low.take(row)
        state += slot
        need = np.flatnonzero(state < LOW)
        owner = need // lanes
        count = np.bincount(owner, minlength=len(ptr))
        place = (ptr - np.cumsum(count) + count).take(owner) + np.arange(len(need))
        state[need] = (state.take(need) << word) | stream.take(place)
        ptr += count
    out = out.reshape(steps, len(chosen), lanes).swapaxes(0, 1).reshape(len(chosen), -1)
    ids = symbols[out]
    del out, stream
    size = steps * lanes
    parts = [row[: min(size, n - b * size)] for b, row in zip(chosen.tolist(), ids, strict=True)]
    for b, row in zip(chosen.tolist(), parts, strict=True):
        if zlib.crc32(row.astype("<u4", copy=False)) != checks[b]:
            raise ValueError(f"the checksum of block {b} differs")
    return ids.reshape(-1)[:n] if only is None else np.concatenate(parts), lengths


#: UTF-8 byte -> character in byte-level BPE: printable Latin-1 bytes stand for themselves, others for 256, 257, ...
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
#: Letters with one lower-case form and no further composition: Latin-1 and Latin Extended-A but for capital I with dot.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"


# The settings of a tokenizer file under which words can be tokenized one by one.
WORDWISE = {
    "truncation": None,
    "padding": None,
    "post_processor": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
WORDWISE_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def is_wordwise(settings: dict) -> bool:
    """Whether a tokenizer file has the settings that :class:`WordTokens` cuts words by; its vocabulary is its own."""
    own = {k: settings.get(k) for k in WORDWISE}
    model = {k: settings["model"].get(k) for k in WORDWISE_MODEL}
    return own == WORDWISE and model == WORDWISE_MODEL and all(t["content"].startswith("<|") for t in settings.get("added_tokens", []))


class WordTokens(dict):
    """Word -> its ids as little-endian uint32 bytes, from the tokenizer, remembered.

    That is for tokenizers which treat texts word by word (white space is dropped and nothing joins across
    it, see :func:`is_wordwise`); :meth:`encode` then gives the ids of whole texts. With any other tokenizer :meth:`encode`
    sends whole texts through the library. Words of printable ASCII and Latin letters
    are cut by the tokenizer's own pattern first, as cut pieces repeat more often than words; a
    piece goes to the tokenizer's BPE model. Any other word, and one that may hold a special token,
    goes through the whole tokenizer. Both memories forget all at ``most`` entries.
    """

    def __init__(self, path: str, most: int = 250_000):
        super().__init__()
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.wordwise = is_wordwise(json.load(f))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.most = most
        self.pieces: dict[str, bytes] = {}
        #: The pre-tokenizer's pattern, for lower-case text of those characters.
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\sa-z0-9{_LATIN}]+").findall
        self.simple = re.compile(rf"[!-~{_LATIN}]*").fullmatch

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= self.most:
            self.pieces.clear()
        shown = piece if piece.isascii() else "".join(map(BYTE_CHARS.__getitem__, piece.encode()))
        ids = [t.id for t in self.model.tokenize(shown)]
        value = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return value

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if self.simple(word) and "<|" not in word:
            pieces = self.pieces
            value = b"".join([pieces.get(p) or self._piece(p) for p in self.cut(word.lower())])
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            value = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = value
        return value

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end_id``; numbers of ids). Null is empty."""
        import pyarrow.compute as pc

        if not self.wordwise:
            lists = [np.array([*e.ids, end_id], "<u4") for e in self.tokenizer.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        values = list(map(self.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
        size = np.fromiter(map(len, values), np.int32, len(values)) >> 2
        pool = np.frombuffer(b"".join(values), "<u4")
        n = size[at]
        ends = np.cumsum(n)
        shift = np.cumsum(size) - size
        ids = pool[np.repeat((shift[at] - (ends - n)).astype(np.int32), n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        stops = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return np.insert(ids, stops[1:], end_id), np.diff(stops) + 1


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    ends = np.cumsum(byte_lengths(texts))
    start, base = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop - start
        start, base = stop, int(ends[stop - 1])


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; 0 for null."""
    import pyarrow.compute as pc

    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this worker process, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def segment(part: int, number: int, start: int, ids: list[np.ndarray], sizes: list[np.ndarray], doc_ids: list[pa.Array]) -> pa.RecordBatch:
    """A row of the table of segments."""
    flat, lengths = np.concatenate(ids), np.concatenate(sizes)
    ids.clear()  # they are all in ``flat``
    keys = pa.concat_arrays(doc_ids)
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([len(flat)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([encode(flat, lengths)], pa.binary())],
        ["part", "segment", "start_in_part", "n_ids", "doc_ids", "data"],
    )


SEGMENT_SCHEMA = "part int, segment int, start_in_part long, n_ids long, doc_ids array<long>, data binary"


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS, slice_bytes: int = SLICE_BYTES) -> None:
    """Tokenizes every whole text, appends ``end_id``, and writes the ids in ascending order of id.

    ``path`` gets Parquet rows (part, segment, start_in_part, n_ids, doc_ids, data): parts in order
    of id, ``data`` the binary segments of the module's format. A segment ends with a document, after
    the slice of texts (``slice_bytes``) that fills it. Null
    and empty texts have just the end id; null ids come first; rows with equal ids are ordered by
    their text's hash, and equal rows are dealt over tasks like others; an empty table writes no segment; other columns are not read. A task holds one segment
    and one Arrow batch, and a long document makes its own segment longer. Any file of the tokenizers library serves;
    those that go word by word are faster.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokens = TaskContext.get().partitionId(), word_tokens(tokenizer)
        ids, sizes, doc_ids, n, start, number = [], [], [], 0, 0, 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, length in slices(texts, slice_bytes):
                more, size = tokens.encode(texts.slice(at, length), end_id)
                ids.append(more)
                sizes.append(size)
                doc_ids.append(keys.slice(at, length))
                n += len(more)
                if n >= segment_ids:
                    yield segment(part, number, start, ids, sizes, doc_ids)
                    ids, sizes, doc_ids, n, start, number = [], [], [], 0, start + n, number + 1
        if n:
            yield segment(part, number, start, ids, sizes, doc_ids)

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "spread"]
    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("spread"))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("spread")
        .mapInArrow(tidy(segments), SEGMENT_SCHEMA)
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def read_segments(spark, path: str) -> DataFrame:
    """Segments with ``start``, the ids of all parts and segments before.

    The driver gets one sum for each part, as many as the write had tasks.
    """
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sums = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = [(-1, 0)], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    rows = ", ".join(f"({p}, {s}L)" for p, s in starts)
    parts = spark.sql(f"SELECT * FROM VALUES {rows} AS t(part, _start)")
    return table.join(F.broadcast(parts), "part").withColumn("start", F.col("_start") + F.col("start_in_part")).drop("_start")


def document_index(segments: DataFrame) -> DataFrame:
    """Decodes segments: doc_id, start, n_tokens and ids_crc32 (little-endian uint32) of each document."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids, lengths = decode(data.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.as_py(), pa.int64()), pa.array(ends - lengths + start.as_py(), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("start", "doc_ids", "data").mapInArrow(tidy(index), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_token_ids(segments: DataFrame) -> DataFrame:
    """Decodes segments: doc_id and its ``ids`` array, the end id included."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, data in zip(batch.column(0), batch.column(1), strict=True):
                ids, lengths = decode(data.as_py())
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids.as_py(), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return segments.select("doc_ids", "data").mapInArrow(tidy(rows), "doc_id long, ids array<int>")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes ``docs`` (to scratch where no path is given) and returns :func:`document_index` of the files."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-ids")
    write_token_ids(docs, path, tokenizer, end_id)
    return document_index(read_segments(spark, path))
