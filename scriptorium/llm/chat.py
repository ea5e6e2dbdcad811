"""Chat formatting after cumulative-snapshot collapse.

Chat logs often hold a conversation once for each turn, every snapshot a prefix of the next. Rolling hashes
of turn prefixes find them: a conversation whose whole hash is a proper prefix's hash of another one is a
snapshot and goes, by an anti-join. Of equal conversations the smallest id stays. What remains is
rendered as one string.

A prefix hash is three running sums of 40-bit turn hashes, each turn hashed with its place, so prefixes come
from one sort by conversation and no conversation is held in memory to find snapshots. With the number of turns,
prefixes of different content agree by chance with a probability of about 2**-120 a pair: for ten billion conversations
of ten turns each, 1e21 pairs, that is below 1e-14 for the whole corpus. Texts aren't compared again.

Turns without conversation id belong to no conversation: each is one of its own, of a single turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, stored

HASHES = ["p1", "p2", "p3"]


def turn_hashes(place: Column | str) -> list[Column]:
    """Three 40-bit hashes of a turn at its place."""
    return [F.pmod(F.xxhash64(F.lit(k), place, "role", "text"), F.lit(1 << 40)).alias(p) for k, p in enumerate(HASHES)]


def _turns(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, i, n, p1, p2, p3): the hashes of the first ``i`` of ``n`` turns; turns ordered by turn, role, text."""
    conv = Window.partitionBy("conv_id")
    ordered = conv.orderBy("turn", "role", "text")
    placed = _turns(turns).where("conv_id IS NOT NULL").withColumn("i", F.row_number().over(ordered))
    hashed = placed.select("conv_id", "i", "turn", "role", "text", *turn_hashes("i"))
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = hashed.select("conv_id", "i", *[F.sum(p).over(running).alias(p) for p in HASHES])
    return summed.withColumn("n", F.max("i").over(conv))


def lone_turns(turns: DataFrame) -> DataFrame:
    """(role, text, copies, p1, p2, p3) of turns without conversation id, equal ones together."""
    counted = _turns(turns).where("conv_id IS NULL").groupBy("role", "text").agg(F.count("*").alias("copies"))
    return counted.select("role", "text", "copies", *turn_hashes(F.lit(1)))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, hashes) of conversations that are no proper prefix of another; ``copies`` counts equal ones.

    ``conv_id`` is null where all the equal ones are turns without id.
    """
    found = stored(prefixes(turns), "prefixes")
    proper = found.where("i < n").select("i", *HASHES).distinct()
    whole = found.where("i = n").select("i", *HASHES, "conv_id", F.lit(1).cast("long").alias("copies"))
    lone = lone_turns(turns).select(F.lit(1).alias("i"), *HASHES, F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), "copies")
    whole = whole.unionByName(lone).groupBy("i", *HASHES).agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("copies"))
    kept = stored(whole.join(proper, ["i", *HASHES], "left_anti").select("conv_id", F.col("i").cast("long").alias("n_turns"), "copies", *HASHES), "maximal")
    discard(found)
    return kept


def rendered(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """Maximal conversations: conv_id, n_turns, copies and ``rendered``, ``{start}{role}\\n{text}{end}\\n`` for each turn.

    Turns go by (turn, role, text), so ties have one order and repeated rows are repeated turns. Null
    role and text are empty; a row without conv_id is a conversation of one turn; an empty table gives no rows;
    other columns are not read. A conversation is rendered in one row, so it must fit into a task.
    """
    kept = maximal(turns)
    line = lambda t: F.concat(F.lit(start), t["role"], F.lit("\n"), t["text"], F.lit(f"{end}\n"))
    own = _turns(turns).select("conv_id", F.struct("turn", "role", "text").alias("t"))
    joined = own.join(kept.select(F.col("conv_id").alias("of"), "n_turns", "copies"), F.col("conv_id") == F.col("of"))
    whole = joined.groupBy("conv_id", "n_turns", "copies").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), line), "").alias("rendered"))
    lone = lone_turns(turns).drop("copies").join(kept.where("conv_id IS NULL"), HASHES)
    return whole.unionByName(lone.select("conv_id", "n_turns", "copies", line(F.struct("role", "text")).alias("rendered")))
