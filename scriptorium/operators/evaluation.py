"""Quality of chunks and of chunking strategies: sizes, citations, coherence, boundaries, recommendation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.models import HashedWords, sentence_coherence, text_cosine
from ..functions.names import normalize_score, token_estimate
from ..functions.text import count_citations, decimals, long_sentences
from ..scratch import stored


def _group(chunks: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    return chunks.groupBy(*by).agg(*aggregates) if by else chunks.agg(*aggregates)


def chunk_statistics(chunks: DataFrame, by: list[str] = (), text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """Count, mean, interpolated median, population deviation, least and largest length, mean and median tokens; zeros if empty."""
    size, tokens = F.length(text_col), token_estimate(text_col) if tokens is None else tokens
    values = {
        "count": F.count("*"), "mean_chars": F.avg(size), "median_chars": F.percentile(size, F.lit(0.5)), "std_chars": F.stddev_pop(size),
        "min_chars": F.min(size), "max_chars": F.max(size), "mean_tokens": F.avg(tokens), "median_tokens": F.percentile(tokens, F.lit(0.5)),
    }
    return _group(chunks, list(by), *[F.coalesce(v, F.lit(0)).alias(k) for k, v in values.items()])


def upper_median_statistics(chunks: DataFrame, by: list[str] = (), text_col: str = "text") -> DataFrame:
    """Count, mean, least, largest and upper median length, and mean tokens.

    The upper median is the element after the lower half: the value of rank ``n div 2`` from 0, found from counts of
    lengths, so no group's lengths are gathered in one place.
    """
    by = list(by)
    sizes = chunks.select(*by, F.length(text_col).alias("_size"), token_estimate(text_col).alias("_tokens"))
    counts = sizes.groupBy(*by, "_size").agg(F.count("*").alias("_n"), F.sum("_tokens").alias("_t"))
    window = Window.partitionBy(*(by or [F.lit(0)]))
    placed = counts.withColumns({"_below": F.sum("_n").over(window.orderBy("_size")) - F.col("_n"), "_all": F.sum("_n").over(window)})
    half = F.floor(F.col("_all") / 2)
    middle = F.max(F.when((F.col("_below") <= half) & (half < F.col("_below") + F.col("_n")), F.col("_size")))
    return _group(
        placed, by, F.sum("_n").alias("count"), (F.sum(F.col("_size") * F.col("_n")) / F.sum("_n")).alias("mean_chars"), F.min("_size").alias("min_chars"),
        F.max("_size").alias("max_chars"), middle.alias("median_chars"), (F.sum("_t") / F.sum("_n")).alias("mean_tokens"),
    )


def citation_integrity(chunks: DataFrame, by: list[str] = (), text_col: str = "text") -> DataFrame:
    """Citations, chunks with one, their share, their mean density for 1,000 characters, and all chunks; zeros if empty."""
    counted = chunks.select(*by, count_citations(text_col).alias("_c"), F.length(text_col).alias("_size"))
    density = F.avg(F.when(F.col("_c") > 0, F.try_divide(F.col("_c") * 1000.0, F.col("_size"))))
    values = {"total_citations": F.sum("_c"), "chunks_with_citations": F.count_if(F.col("_c") > 0), "citation_coverage": F.avg((F.col("_c") > 0).cast("double")), "citation_density": density, "total_chunks": F.count("*")}
    return _group(counted, list(by), *[F.coalesce(v, F.lit(0)).alias(k) for k, v in values.items()])


def coherence(chunks: DataFrame, model: Callable = HashedWords, text_col: str = "text", least: int = 2) -> DataFrame:
    """Adds ``coherence``: the mean cosine of a chunk's sentences of over 20 characters; 1 below ``least`` sentences."""
    return chunks.withColumn("coherence", sentence_coherence(long_sentences(text_col), model, least))


def boundary_sentences(text: Column) -> Column:
    """Non-empty pieces between runs of ``.!?`` with Unicode's white space after, without spaces at either end."""
    # Not F.trim itself: a function of two parameters gets a sentence's place as well, and would trim its digits.
    return F.filter(F.transform(F.split(text, r"(?U)[.!?]+\s+"), lambda s: F.trim(s)), lambda s: s != "")


def boundary_pairs(chunks: DataFrame, partition: list[str], order: list[str], text_col: str = "text", cut: Callable[[Column], Column] = boundary_sentences) -> DataFrame:
    """(partition, order, last, first): the last sentence of each chunk and the first of the next one of its paper.

    Pairs in which either is below 20 characters are left out. ``partition`` may be constant to cross papers; ``cut`` gives a text's sentences.
    """
    window = Window.partitionBy(*partition).orderBy(*order)
    sentences = chunks.select(*partition, *order, cut(F.col(text_col)).alias("_s"))
    ends = sentences.select(*partition, *order, F.try_element_at("_s", F.lit(-1)).alias("last"), F.get("_s", F.lit(0)).alias("_first"))
    paired = ends.withColumn("first", F.lead("_first").over(window)).drop("_first")
    return paired.where((F.length("last") >= 20) & (F.length("first") >= 20))


def boundary_quality(chunks: DataFrame, partition: list[str], order: list[str], model: Callable = HashedWords, text_col: str = "text", cut: Callable[[Column], Column] = boundary_sentences) -> DataFrame:
    """:func:`boundary_pairs` with their cosine ``boundary``; lower is better. All pairs are scored, none sampled."""
    pairs = boundary_pairs(chunks, partition, order, text_col, cut)
    return pairs.withColumn("boundary", F.nanvl(text_cosine("last", "first", model), F.lit(None)))


def strategy_score(metrics: DataFrame) -> DataFrame:
    """Adds ``score`` from coherence, boundary, citation_coverage, std_chars and mean_chars; a missing metric adds nothing."""
    std, mean = F.coalesce("std_chars", F.lit(1000.0)), F.coalesce("mean_chars", F.lit(0.0))
    spread = F.when(std > 2000, F.lit(0.0)).when(std > 1000, (2000 - std) / 1000 * 25).otherwise(25 - std / 200)
    size = F.when(mean.between(1800, 2500), 20.0).when(mean.between(1500, 3000), 15.0).when(mean.between(1000, 4000), 10.0).otherwise(0.0)
    parts = [F.col("coherence") * 15, (1 - F.col("boundary")) * 20, F.col("citation_coverage") * 20]
    return metrics.withColumn("score", sum((F.coalesce(p, F.lit(0.0)) for p in parts), spread + size))


def recommended(metrics: DataFrame, name_col: str = "strategy") -> DataFrame:
    """The name with the highest score; of equals, the first in order of name."""
    return strategy_score(metrics).orderBy(F.desc("score"), name_col).limit(1).select(name_col, "score")


#: Columns of the comparison matrix, and whether lower is better.
COMPARED = {"coherence": False, "boundary": True, "citation_coverage": False, "mean_chars": False, "std_chars": True}


def comparison_matrix(metrics: DataFrame, name_col: str = "strategy") -> DataFrame:
    """Metrics scaled to 0..1 over the strategies; constant columns stay as they are. One row for each strategy."""
    ends = metrics.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(f"_{c}") for c in COMPARED])
    joined = metrics.crossJoin(F.broadcast(ends))  # one row

    def scaled(c: str, invert: bool) -> Column:
        low, high = F.col(f"_{c}")["low"], F.col(f"_{c}")["high"]
        return F.when(low == high, F.col(c)).otherwise(normalize_score(F.col(c), low, high, invert))

    return joined.select(name_col, *[scaled(c, invert).alias(c) for c, invert in COMPARED.items()])


def size_histogram(chunks: DataFrame, by: str = "strategy", bins: int = 30, text_col: str = "text") -> DataFrame:
    """(by, bin from 0, chunks): counts of lengths in equal bins between each group's least and largest length."""
    sizes = chunks.select(by, F.length(text_col).cast("double").alias("size"))
    ends = sizes.groupBy(by).agg(F.min("size").alias("low"), F.max("size").alias("high"))
    width = F.greatest((F.col("high") - F.col("low")) / bins, F.lit(1e-9))
    placed = F.least(F.lit(bins - 1), F.floor((F.col("size") - F.col("low")) / width)).cast("int")
    return sizes.join(ends, by).select(by, placed.alias("bin")).groupBy(by, "bin").agg(F.count("*").alias("chunks"))


def score_spread(scores: DataFrame, by: str, score_col: str) -> DataFrame:
    """Quartiles, mean and deviation of a score in each group: the numbers behind box and violin plots."""
    quartiles = F.percentile(score_col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return scores.groupBy(by).agg(F.count(score_col).alias("n"), quartiles[0].alias("q1"), quartiles[1].alias("median"), quartiles[2].alias("q3"), F.avg(score_col).alias("mean"), F.stddev_pop(score_col).alias("std"))


def report_rows(metrics: DataFrame, name_col: str = "strategy") -> DataFrame:
    """Metrics as text: sizes with one decimal, scores with three, ``N/A`` where there is none (a score of 0 is a score)."""
    text = lambda c, places: F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(decimals(F.col(c), places))
    return metrics.select(name_col, *[text(c, 1).alias(c) for c in ("mean_chars", "std_chars")], *[text(c, 3).alias(c) for c in ("coherence", "boundary", "citation_coverage")])


def evaluate(chunks: DataFrame, model: Callable = HashedWords) -> DataFrame:
    """All metrics of chunks with ``strategy``, ``paper_id`` and ``chunk_index``; every chunk and pair is scored.

    Chunks are stored first, so documents are cut once, not for each metric.
    """
    chunks = stored(chunks, "evaluated-chunks")
    out = chunk_statistics(chunks, ["strategy"]).join(citation_integrity(chunks, ["strategy"]), "strategy")
    out = out.join(coherence(chunks, model).groupBy("strategy").agg(F.avg("coherence").alias("coherence")), "strategy", "left")
    pairs = boundary_quality(chunks, ["strategy", "paper_id"], ["chunk_index"], model)
    return out.join(pairs.groupBy("strategy").agg(F.avg("boundary").alias("boundary")), "strategy", "left")


def embedding_cost(chunks: DataFrame, price: float, sample: int = 100, order: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(total_texts, tokens, cost): mean tokens of the first ``sample`` texts carried to all; zeros if empty."""
    first = chunks.orderBy(order).limit(sample).agg(F.avg(token_estimate(text_col)).alias("_mean"))
    whole = chunks.agg(F.count("*").alias("total_texts")).crossJoin(F.broadcast(first))  # two rows of one
    tokens = F.coalesce((F.col("_mean") * F.col("total_texts")).cast("long"), F.lit(0).cast("long"))
    return whole.select("total_texts", tokens.alias("tokens"), (tokens / 1_000_000 * price).alias("cost"))


def sample_chunks(chunks: DataFrame, n: int = 20, seed: int = 0, key: str = "chunk_id") -> DataFrame:
    """``n`` chunks without replacement, the same for a seed whatever the partitions: those of the least hash of seed and key."""
    return chunks.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def overlap_efficiency(chunks: DataFrame, by: list[str] = ()) -> DataFrame:
    """The reference's measure of overlap, which it leaves at 0 for every strategy."""
    return _group(chunks, list(by), F.lit(0.0).alias("overlap_efficiency"))
