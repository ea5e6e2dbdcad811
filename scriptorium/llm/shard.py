"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0..n-1 in order of id (ties: by text hash), a keyed bijection of 0..n-1
shuffles the numbers, and the shuffled number p gives shard ``p % shards`` and slot
``p div shards``. Shard sizes differ by one at most, slots have no gaps, and :func:`place` finds
shard and slot of any row number without the data.

The permutation is an unbalanced Feistel network on pairs (l, r), l < a, r < b, with a * b >= n and
as little excess as 1,024 choices of ``a`` allow. A value that leaves at n or above walks on along
its cycle until it is below n. All such walks start in the excess, so the driver walks them
beforehand, and a row needs one lookup in that short list.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from ..operators.numbering import numbered
from .common import discard, isqrt_up

#: Modulus of the round function; squares of smaller values fit into 63 bits.
PRIME = 2_147_483_647
ROUNDS = 8


def domain(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n: of 1,024 values of a from the root of n on, the one with least excess."""
    root = isqrt_up(n)
    return min(((a, -(-n // a)) for a in range(root, root + 1024)), key=lambda x: (x[0] * x[1], x[0]))


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two keys below PRIME for each round."""
    digest = lambda i, j: int.from_bytes(hashlib.sha256(f"{seed}/{i}/{j}".encode()).digest()[:8], "big")
    return [(digest(i, 0) % PRIME, digest(i, 1) % PRIME) for i in range(ROUNDS)]


def _round(v, k1: int, k2: int):
    """The round function, on Python integers and on columns alike."""
    s = (v + k1) % PRIME
    t = (s * s + k2) % PRIME
    u = (t + v) % PRIME
    return (u * u + t) % PRIME


def permute(x: int, a: int, b: int, keys: list[tuple[int, int]]) -> int:
    """One pass of the network over 0..a*b-1."""
    left, right = divmod(x, b)
    for i, (k1, k2) in enumerate(keys):
        if i % 2 == 0:
            left = (left + _round(right, k1, k2)) % a
        else:
            right = (right + _round(left, k1, k2)) % b
    return left * b + right


def walks(n: int, a: int, b: int, keys: list[tuple[int, int]]) -> list[int]:
    """Where the walk from each value n..a*b-1 of the excess first gets below n."""
    ends = []
    for x in range(n, a * b):
        while (x := permute(x, a, b, keys)) >= n:
            pass
        ends.append(x)
    return ends


def place(row: int, n: int, n_shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a global row number; needs no data."""
    a, b = domain(n)
    keys = round_keys(seed)
    x = row
    while (x := permute(x, a, b, keys)) >= n:
        pass
    return x % n_shards, x // n_shards


def feistel_positions(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Adds ``position``: the image of ``row_number`` under the permutation of 0..n-1."""
    if n == 0:
        return df.withColumn("position", F.col("row_number"))
    a, b = domain(n)
    keys = round_keys(seed)
    kept = list(df.columns)
    left, right = F.col("_left"), F.col("_right")
    df = df.select(*kept, F.floor(F.col("row_number") / F.lit(b)).alias("_left"), (F.col("row_number") % b).alias("_right")) if n < 1 << 50 else df.selectExpr("*", f"row_number div {b}L AS _left", f"row_number % {b}L AS _right")
    for i, (k1, k2) in enumerate(keys):
        if i % 2 == 0:
            df = df.select(*kept, ((left + _round(right, k1, k2)) % a).alias("_left"), right)
        else:
            df = df.select(*kept, left, ((right + _round(left, k1, k2)) % b).alias("_right"))
    ends = walks(n, a, b, keys)
    image = left * b + right
    if ends:
        table = F.array(*[F.lit(e).cast("long") for e in ends])
        df = df.select(*kept, image.alias("_image"))
        image = F.when(F.col("_image") < n, F.col("_image")).otherwise(F.get(table, (F.col("_image") - n).cast("int")))
    return df.select(*kept, image.alias("position"))


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard and slot, with the size and checksum of its text.

    Returns id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``row_number``, ``position``,
    ``shard``, ``slot``. A null or empty text has size 1 and checksum 0; null ids come first in the
    order; rows with equal ids are ordered by text, equal rows are interchangeable; an empty table
    gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_tie"),
    )
    rows, n = numbered(slim, [F.col(c) for c in ("doc_id", "size", "text_crc32", "_tie")])
    out = feistel_positions(rows.drop("_tie"), n, seed)
    return out.withColumns({"shard": (F.col("position") % n_shards).cast("int"), "slot": F.floor(F.col("position") / n_shards) if n < 1 << 50 else F.expr(f"position div {n_shards}")})


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, seed: int = 0) -> None:
    """Writes whole rows with their ``slot`` as ``path/shard=k``, each shard's rows in slot order, as :func:`shard_documents` places them.

    Rows are numbered whole, so ids may be null or repeat: no row is lost or doubled. Columns named ``shard`` or ``slot``
    are replaced.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    text = F.coalesce("row.text", F.lit(""))
    order = [F.col("row.doc_id"), F.octet_length(text), F.crc32(text.cast("binary")), F.xxhash64(text)]
    rows, n = numbered(docs.select(F.struct(*columns).alias("row")), order)
    placed = feistel_positions(rows.select("row", "row_number"), n, seed).select("row", (F.col("position") % n_shards).cast("int").alias("shard"), F.expr(f"position div {n_shards}").alias("slot"))
    dealt = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("row.*", "slot", "shard").write.partitionBy("shard").parquet(path)
    discard(rows)


__all__ = ["domain", "feistel_positions", "numbered", "permute", "place", "round_keys", "shard_documents", "walks", "write_shards"]
