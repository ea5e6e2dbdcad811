"""Exact deduplication against a minimal perfect hash over the distinct digests of history.

Texts are equal when their SHA-256 digests are. History, the documents of earlier batches, is reduced to its distinct digests
and these are dealt into buckets by hash. Each bucket is one row of the index: a minimal perfect hash sends its n digests to the
slots 0..n-1, and slot i holds the i-th digest in full, all 32 bytes, with the locator of the group's winner (id and row) and the group's size.

The hash has levels of bits (two for each digest that is left). A digest that is alone at its place in a level gets that
place's bit; the others go on to the next level, until none is left. Its slot is the number of bits before its own. A digest that isn't in
the history falls through all levels or lands in a slot of another one, so every lookup compares the full digest byte by byte: equal
ones are repeats of history and may only move their group's winner and size, and all others are grouped among themselves.

A batch is reduced to distinct digests before it is shuffled, so a text that is a third of all rows is one row for each task. Buckets hold
about BUCKET digests whatever the corpus's size, as their number grows with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, mix, stored

#: Digests of a bucket, and the fewest buckets.
BUCKET, LEAST_BUCKETS = 50_000, 96
#: Groups with more than this share of all rows, fewer than 1,000 of them by counting, are broadcast, so no key of a join is hot.
HOT_SHARE = 1_000
LEAST = -(1 << 63)

GROUPS = "digest binary, keep_id long, keep_row long, group_size long, known boolean"
INDEX = "bucket int, levels array<binary>, digests binary, keep_id array<long>, keep_row array<long>, group_size array<long>"


def words_of(digests: list[bytes]) -> np.ndarray:
    """Four unsigned 64-bit words of each digest."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where digests fall among the bits of a level; every level hashes anew."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(words[:, level % 4] + mix(words[:, (level + 1) % 4] ^ salt)) % np.uint64(size)).astype(np.int64)


def perfect_hash(words: np.ndarray) -> list[np.ndarray]:
    """The levels, as arrays of booleans, for distinct digests; ValueError where one repeats."""
    levels, left = [], words
    while len(left):
        if len(levels) > 256:
            raise ValueError("digests repeat")
        size = max(8, 2 * len(left))
        place = places(left, len(levels), size)
        count = np.bincount(place, minlength=size)
        levels.append(count == 1)
        left = left[count[place] > 1]
    return levels


def slots(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot of each digest; of one that isn't a member any slot, or -1."""
    found, left, before = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for i, bits in enumerate(levels):
        place = places(words[left], i, len(bits))
        hit = bits[place]
        found[left[hit]] = before + np.cumsum(bits)[place[hit]] - 1
        left, before = left[~hit], before + int(bits.sum())
    return found


def digest_of(text: Column) -> Column:
    """32 bytes; null texts are empty texts."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored row (doc_id, digest, row) for each row; ``row`` is a number of its own, null texts count as empty."""
    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


def buckets_for(n_rows: int) -> int:
    return max(LEAST_BUCKETS, -(-n_rows // BUCKET))


def grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, digest, keep_id, keep_row, group_size) of (doc_id, digest, row) rows; the largest id is kept, null before all others."""
    order = F.coalesce("doc_id", F.lit(LEAST))
    found = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.max_by("row", order).alias("keep_row"), F.count("*").alias("group_size"))
    return found.select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"), "digest", "keep_id", "keep_row", "group_size")


def history_index(rows: DataFrame, buckets: int) -> DataFrame:
    """The index (a row for each bucket) over (doc_id, digest, row) rows of history; to be stored, and looked up with as many buckets."""

    def build(table: pa.Table) -> pa.Table:
        digests = table["digest"].to_pylist()
        words = words_of(digests)
        levels = perfect_hash(words)
        order = np.empty(len(digests), np.int64)
        order[slots(levels, words)] = np.arange(len(digests))
        held = {"digests": [b"".join(digests[i] for i in order.tolist())]}
        for name in ("keep_id", "keep_row", "group_size"):
            held[name] = [table[name].combine_chunks().take(pa.array(order)).to_pylist()]
        longs = pa.list_(pa.int64())
        return pa.table({
            "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()),
            "levels": pa.array([[len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes() for bits in levels]], pa.list_(pa.binary())),
            "digests": pa.array(held["digests"], pa.binary()), **{c: pa.array(held[c], longs) for c in ("keep_id", "keep_row", "group_size")},
        })

    return grouped(rows, buckets).groupBy("bucket").applyInArrow(build, INDEX)


def looked_up(index: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """GROUPS of history and an arriving batch together: ``known`` says that history has the digest already.

    Arriving digests are looked up by slot and compared byte by byte; nonmembers are groups of their own.
    """

    def look(arriving: pa.Table, history: pa.Table) -> pa.Table:
        new = {c: arriving[c].to_pylist() for c in ("digest", "keep_id", "keep_row", "group_size")}
        if not len(history):
            return pa.table({**new, "known": [False] * len(arriving)}, schema=SCHEMA)
        full = history["digests"][0].as_py()
        old = {c: history[c][0].as_py() for c in ("keep_id", "keep_row", "group_size")}
        old["digest"] = [full[i : i + 32] for i in range(0, len(full), 32)]
        levels = [np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")).astype(bool) for x in history["levels"][0].as_py()]
        out = {c: list(old[c]) for c in new}
        found = slots(levels, words_of(new["digest"])).tolist() if len(arriving) else []
        for i, slot in enumerate(found):
            if slot < 0 or old["digest"][slot] != new["digest"][i]:  # not a member, whatever slot it has
                for c, values in new.items():
                    out[c].append(values[i])
                continue
            out["group_size"][slot] += new["group_size"][i]
            if new["keep_id"][i] is not None and (out["keep_id"][slot] is None or new["keep_id"][i] > out["keep_id"][slot]):
                out["keep_id"][slot], out["keep_row"][slot] = new["keep_id"][i], new["keep_row"][i]
        known = len(old["digest"])
        return pa.table({**out, "known": [True] * known + [False] * (len(out["digest"]) - known)}, schema=SCHEMA)

    SCHEMA = pa.schema([("digest", pa.binary()), *[(c, pa.int64()) for c in ("keep_id", "keep_row", "group_size")], ("known", pa.bool_())])
    return grouped(rows, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look, GROUPS)


def decided(rows: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """Each (doc_id, digest, row) row with its group's keep_id, keep_row, group_size and known.

    Groups of more than a thousandth of all rows are fewer than a thousand, so they are broadcast; in the shuffle join of the
    rest no key has more rows than that.
    """
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_SHARE > n_rows))
    rest = groups.where(F.col("group_size") * HOT_SHARE <= n_rows)
    few = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest")
    return rows.join(hot, "digest").unionByName(few)


def exact_duplicates(docs: DataFrame, historical: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and known (its text is in the history).

    ``historical`` (a condition on columns of ``docs``; null is no) marks the rows of earlier batches: the index is made of them, all
    other rows arrive and are looked up. What is decided holds for both together: of equal texts the row with the largest id stays, wherever it is.
    Null texts are empty texts. A null id is smaller than all others, so a row without id stays only in a group without ids; of rows
    with the same text and the same largest id exactly one stays. An empty history or an empty batch is allowed, an empty table gives no
    rows; other columns are not read.
    """
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(historical, F.lit(False)).alias("old"))
    rows = stored(marked.select("doc_id", digest_of(F.col("text")).alias("digest"), "old", F.monotonically_increasing_id().alias("row")), "digests")
    n_rows = rows.count()
    buckets = buckets_for(n_rows)
    index = stored(history_index(rows.where("old"), buckets), "history")
    groups = stored(looked_up(index, rows.where("NOT old"), buckets), "groups")
    discard(index)
    kept = (F.col("row") == F.col("keep_row")).alias("kept")
    return decided(rows, groups, n_rows).select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"), "known")


def new_documents(docs: DataFrame, index: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows of an arriving batch whose text the history doesn't have, one of each group: of the largest id.

    ``index`` is a stored :func:`history_index` with as many ``buckets``. Nulls and ties as in :func:`exact_duplicates`; columns may
    have any names. The batch is stored with row numbers, as rows with one id may differ in other columns.
    """
    batch = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "batch")
    rows = batch.select(F.col("doc")[id_col].cast("long").alias("doc_id"), digest_of(F.col("doc")[text_col]).alias("digest"), "row")
    stay = looked_up(index, rows, buckets).where("NOT known").select(F.col("keep_row").alias("row"))
    return batch.join(stay, "row", "left_semi").select("doc.*")
