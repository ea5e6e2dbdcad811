"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its share of the mixture over its share of the corpus, in UTF-8 bytes. Each
document occurs Poisson(rate) times: a hash of seed and id gives a uniform number, and the inverse
of the distribution function gives the count. So a document's count depends on its id, its source's
rate and the seed alone. Copies are exploded and put in the order of another hash, which shuffles
them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: A larger rate is the sum of independent parts of at most this rate, as exp(-rate) must not vanish.
PART = 16.0
#: Counts of a part beyond this have probabilities below 1e-30.
MOST = 96
#: The table of sources is broadcast up to so many bytes, each with its name and its distribution; beyond, it is joined with the sources salted.
BROADCAST_BYTES = 64 << 20
SALTS = 64
#: Bytes of text in a partition of the shuffled output, and the most partitions.
PARTITION_BYTES, MOST_PARTITIONS = 256 << 20, 200_000


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the MD5 of the parts, joined by colons: 52 bits."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row: within a lambda function it would be for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to MOST, as far as :func:`uniform` can exceed them."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step, lambda acc: acc["all"])
    return F.filter(whole, lambda c: c < 1.0)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate): ``weights`` by source, where absent 0; by default bytes to the given power.

    The mixture has ``epochs`` times the corpus's bytes in expectation. A source without bytes has
    rate ``epochs`` if it has a weight. Rates are rounded to nine decimals. One scan of the texts' lengths.
    """
    return _rates(docs, weights, power, epochs)[0]


def _rates(docs: DataFrame, weights: dict[str, float] | None, power: float, epochs: float) -> tuple[DataFrame, int, int]:
    """Rates, the corpus's bytes, and the bytes of the table with each source's distribution."""
    size = F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("bytes")
    sources = docs.groupBy("source").agg(size)
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(power))
    else:
        pairs = [x for item in weights.items() for x in (F.lit(item[0]), F.lit(float(item[1])))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    sources = stored(sources.withColumn("weight", weight), "sources")
    names = F.sum(F.octet_length(F.coalesce(F.col("source").cast("string"), F.lit("")))).alias("names")
    whole = sources.agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("bytes") > 0, F.col("weight"))).alias("weight"), F.count("*").alias("n"), names).first()
    rate = F.when(F.col("bytes") > 0, F.col("weight") / F.lit(whole["weight"] or 1.0) * F.lit(epochs * (whole["bytes"] or 0)) / F.col("bytes"))
    chosen = F.round(F.coalesce(rate, F.when(F.lit(weights is None) | (F.col("weight") > 0), F.lit(float(epochs))), F.lit(0.0)), 9)
    row = 8 * (MOST + 1) + 64  # a distribution as an array of doubles, and what a row has beside it
    return sources.select("source", chosen.alias("rate")), int(whole["bytes"] or 0), whole["n"] * row + (whole["names"] or 0)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """``docs``, each row as often as its count, shuffled; with ``rate``, ``copy`` (from 1) and ``shuffle_key``.

    Rows with equal ids have equal counts; a row without id goes by its text's hash. A null source is a source, null
    text has no bytes, and an empty table gives no rows. Columns of ``docs`` named ``rate``, ``copy``
    or ``shuffle_key`` are replaced; all others come out as they are, whatever their names.

    The texts are read twice: for the sources' bytes, and to be drawn, copied and shuffled. The shuffle key is uniform, so its
    first digits deal rows into equal ranges, which need no sampling: a partition is a range, sorted within. Its rows have
    about ``PARTITION_BYTES`` of text.
    """
    docs = docs.drop("rate", "copy", "shuffle_key")
    by_source, n_bytes, table_bytes = _rates(docs, weights, power, epochs)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))
    by_source = by_source.select("source", F.struct("rate", parts.alias("parts"), poisson_cdf(F.col("rate") / parts).alias("cdf")).alias("draw"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source").alias("of"), key.alias("key"))
    same = F.col("of").eqNullSafe(F.col("source"))
    if table_bytes <= BROADCAST_BYTES:
        joined = packed.join(F.broadcast(by_source), same)
    else:  # more sources than an executor should hold: a hot source's rows are dealt out by salt
        salted = by_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = packed.withColumn("dealt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("dealt") == F.col("salt")))

    def of_part(i: Column) -> Column:
        return let(uniform(F.lit(str(seed)), F.col("key"), i.cast("string")), lambda u: F.size(F.filter(F.col("draw")["cdf"], lambda c: c <= u)))

    many = F.aggregate(F.sequence(F.lit(1), F.col("draw")["parts"]), F.lit(0), lambda acc, i: acc + of_part(i))
    counted = joined.select("doc", "key", F.col("draw")["rate"].alias("rate"), F.when(F.col("draw")["parts"] == 1, of_part(F.lit(1))).otherwise(many).alias("count"))
    copies = counted.where("count > 0").select("doc", "rate", "key", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    keyed = copies.select("doc", "rate", "copy", F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), "key", F.col("copy").cast("string"))).alias("shuffle_key"))
    n = min(MOST_PARTITIONS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes * epochs) // PARTITION_BYTES)))
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 13), 16, 10).cast("double") / float(1 << 52) * n).cast("int")
    dealt = keyed.repartitionById(n, place).sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col("doc")[c].alias(c) for c in docs.columns], "rate", "copy", "shuffle_key")
