"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Items are short and documents long, so their Jaccard similarity says little. The search is for
containment instead: each item keeps a bottom-s MinHash sketch, its s shingles of smallest hash, and a
document that holds a share c of the item's shingles holds each sketch shingle with chance c. Items are
partitioned by size (doubling bounds), and a partition's sketch length follows from its upper bound q:
``q - ceil(c * q) + 1``. A document with enough of the item then holds at least one sketch shingle for
certain, so candidates miss nothing, and the full shingle sets decide.

Sizes and sketches are on the items' side, where they decide what the search finds: containment is measured by the item's
size, so items are what has to be partitioned for one bound to serve all of a partition, and the sketch of a short item is what
a long document is searched for. A document's own bottom sketch would be of little use: of a text of 20,000 shingles next to
none of its smallest hashes are an item's. So each document offers all of its shingles to the sketches, by a bitmap and a binary
search, and is read once, whatever its size; it needs no class of its own.

The benchmark is the stated query set: blocks of at most ``block_shingles`` shingles go to the executors, each
meets all documents, whole texts, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, shingle_hashes, stored, tidy, words_alnum

#: Digests of contaminated texts (32 bytes each) are broadcast up to this count, and joined by shuffle beyond it.
BROADCAST_DIGESTS = 1_000_000
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double, first_word long, last_word long"


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; runs of different ``k`` never agree."""
    return shingle_hashes(words, k) ^ np.uint64(k * 0x9E3779B9)


def sketch_length(size: int, percent: int) -> int:
    """For the partition of sizes up to 2**b - 1 that ``size`` falls into."""
    top = (1 << size.bit_length()) - 1
    return min(size, top - -(-percent * top // 100) + 1)


class Index:
    """A block of items: a bitmap and sorted array of sketch hashes, and the items' full sets."""

    def __init__(self, items: list[tuple[int, bytes]], k: int, percent: int):
        hashes = WordHashes()
        self.k, self.percent, self.items = k, percent, []
        keys: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = hashes.of(words_alnum(text))
            size = min(k, len(words))
            if not size:
                continue
            full = np.unique(shingles(words, size))
            for h in full[: sketch_length(len(full), percent)]:
                keys.setdefault(size, []).append((int(h), len(self.items)))
            self.items.append((item_id, size, full))
        self.sketches = {}
        for size, pairs in keys.items():
            pairs.sort()
            sketch = np.array([h for h, _ in pairs], np.uint64)
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(sketch >> np.uint64(44)).astype(np.int64)] = True
            self.sketches[size] = (bitmap, sketch, np.array([i for _, i in pairs]))

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, n_item, n_shared, first word, last word) of the items that a document contains."""
        for size, (bitmap, sketch, owners) in self.sketches.items():
            h = shingles(words, size)
            near = h[bitmap[(h >> np.uint64(44)).astype(np.int64)]]
            if not len(near):
                continue
            near = np.unique(near)
            low, high = np.searchsorted(sketch, near), np.searchsorted(sketch, near, side="right")
            found = {int(owners[j]) for a, b in zip(low.tolist(), high.tolist(), strict=True) for j in range(a, b)}
            for i in sorted(found):
                item_id, _, full = self.items[i]
                places = np.flatnonzero(np.isin(h, full))
                shared = len(np.unique(h[places]))
                if 100 * shared >= self.percent * len(full):
                    yield item_id, len(full), shared, int(places[0]), int(places[-1]) + size - 1


def found_items(texts: DataFrame, benchmark: DataFrame, k: int, percent: int, block_shingles: int) -> DataFrame:
    """``texts`` has two columns, a key of any type and a text; the result has the key instead of SCHEMA's doc_id."""
    spark, key = texts.sparkSession, texts.schema.fields[0]
    schema = SCHEMA.replace("doc_id long", f"`{key.name}` {key.dataType.simpleString()}")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    weight = F.sum(F.octet_length("text")).alias("n")
    blocks = max(1, -(-(items.agg(weight).first()["n"] or 0) // (2 * block_shingles)))  # a shingle has two bytes at least

    def search(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                places, rows = [], []
                for place, text in enumerate(batch.column(1).cast(pa.binary())):
                    words = hashes.of(words_alnum(text.as_py() or b""))
                    found = [(item, n, m, m / n, a, b) for item, n, m, a, b in index.matches(words)]
                    places += [place] * len(found)
                    rows += found
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2
                names = [x.split()[0] for x in SCHEMA.split(", ")[1:]]
                keys = batch.column(0).take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [key.name, *names])

        return run

    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = Index([(r["item_id"], bytes(r["text"])) for r in part.collect()], k, percent)
        if index.items:
            found = texts.mapInArrow(tidy(search(index)), schema)
            out = found if blocks == 1 else out.unionByName(stored(found, "contained"))
    return out


def contained(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, block_shingles: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment, first_word, last_word) of items that documents contain.

    An item is contained where a document has ``percent`` of the item's distinct shingles at least (runs of
    ``k`` words; the whole sequence of a shorter item; A-Z lower-cased, words of digits, letters
    and non-ASCII characters). first_word and last_word bound the shared shingles' words, from 0.
    Null and wordless texts contain nothing, and such items are in nothing. Repeated rows of either
    table give repeated results; ids may be null; empty tables give no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return found_items(texts, benchmark, k, percent, block_shingles)


def decontaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, block_shingles: int = 2_000_000) -> DataFrame:
    """``docs`` without the rows whose text contains an item; every other row stays, whatever its id is.

    A row is judged by its own text alone, so ids are not read: they may be null, repeat, or be shared by clean and contaminated rows. Rows are
    matched by a digest of the text (SHA-256), of which equal texts have the same and null texts none. Null, empty and wordless texts
    contain nothing; columns may have any names; an empty benchmark takes nothing away.
    """
    digest = lambda text: F.unhex(F.sha2(F.col(text).cast("binary"), 256))
    texts = docs.where(F.col("text").isNotNull()).select(digest("text").alias("of_text"), "text")
    hit = stored(found_items(texts, benchmark, k, percent, block_shingles).select("of_text").distinct(), "contaminated")
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_DIGESTS else hit
    packed = docs.select(F.struct(*docs.columns).alias("doc"), digest("text").alias("own"))
    return packed.join(hit, F.col("own") == F.col("of_text"), "left_anti").select("doc.*")
