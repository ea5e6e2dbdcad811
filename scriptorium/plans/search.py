"""Queries of sparse and fused search, joins on order, sketches and cubes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.vectors import normalized
from ..operators import chunking, retrieval, sparse, summaries, temporal
from ..sources.files import table
from . import chunks, fixtures


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for each benchmark item, from an inverted index."""
    index = sparse.build(fixtures.documents(spark, sf))
    return sparse.bm25(index, _items(spark, sf), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def letters(text: str) -> F.Column:
    """The unit vector of a text's numbers of a, e and n, and 1."""
    count = lambda c: (F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))).cast("double")
    return normalized(F.array(count("a"), count("e"), count("n"), F.lit(1.0)))


def fused_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty sparse and fifty dense hits for each benchmark item, fused by reciprocal rank."""
    docs = fixtures.documents(spark, sf)
    hits = sparse.bm25(sparse.build(docs), _items(spark, sf), 50)
    dense = retrieval.top_k(docs.select("doc_id", letters("text").alias("embedding")), _items(spark, sf).select("query_id", letters("text").alias("vector")), 50, id_col="doc_id")
    both = [hits, dense.withColumnRenamed("vec_id", "doc_id")]
    return sparse.fused(both, 10).select("query_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long"))


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{sparse.UPPER}', '{sparse.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: All scores of all documents, without an index.
BM25_SQL = f"""d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
c AS (SELECT doc_id, length, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*)::DOUBLE AS df FROM c GROUP BY term),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_words_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)))), 9) AS score
      FROM q JOIN f USING (term) JOIN c USING (term), n GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s)"""
FUSED_SQL = f"""WITH {BM25_SQL}, v AS (SELECT doc_id, {chunks._unit_sql('text')} AS v FROM documents), a AS (SELECT item_id AS query_id, {chunks._unit_sql('text')} AS q FROM benchmark),
e AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q, v) DESC, doc_id) - 1 AS rank FROM a, v),
u AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (61 + rank)), 12) AS score FROM (SELECT query_id, doc_id, rank FROM r WHERE rank < 50 UNION ALL SELECT query_id, doc_id, rank FROM e WHERE rank < 50) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM u)
SELECT query_id, doc_id, round(score, 9) AS score, rank FROM p WHERE rank < 10"""


def chunk_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed chunks with the lines of their document that they share characters with, by places in the text."""
    step = chunks.SPLIT.size - chunks.SPLIT.overlap
    docs = fixtures.documents(spark, sf)
    cut = chunking.plain_chunks(docs, "fixed", chunks.SPLIT, keep=["doc_id"])
    placed = cut.select("doc_id", "chunk_index", (F.col("chunk_index") * step).alias("start"), (F.col("chunk_index") * step + F.col("length")).alias("stop"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    before = F.coalesce(F.sum(F.length("t") + 1).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = lines.select("doc_id", "line", F.length("t").alias("n"), before.alias("start")).select("doc_id", "line", "start", (F.col("start") + F.col("n")).alias("stop"))
    found = temporal.interval_join(placed, spans, ["doc_id"], ("start", "stop"), ("start", "stop"), width=400)
    return found.select("l.doc_id", "l.chunk_index", "r.line", F.greatest("l.start", "r.start").cast("long").alias("start"), F.least("l.stop", "r.stop").cast("long").alias("stop"))


ELEMENTS_SQL = f"""WITH c AS (SELECT doc_id, i AS chunk_index, i * 340 AS start, least(i * 340 + 400, length(text)) AS stop FROM (SELECT doc_id, text, unnest(range((length(text) + 339) // 340)) AS i FROM documents)),
l AS (SELECT doc_id, i - 1 AS line, length(t) AS n, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
SELECT c.doc_id, chunk_index, line, greatest(c.start, l.start)::BIGINT AS start, least(c.stop, l.start + n)::BIGINT AS stop
FROM c JOIN l ON l.doc_id = c.doc_id AND c.start < l.start + n AND l.start < c.stop WHERE c.stop - c.start >= {chunks.SPLIT.least}"""


def asof_price(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the user's last purchase up to then."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = temporal.asof_join(events, events.where("event_type = 'purchase'"), "user_id", "ts", "ts", F.col("event_id"))
    return found.select("l.event_id", "l.user_id", F.col("r.event_id").alias("purchase_id"), F.col("r.value").alias("price"))


ASOF_SQL = """SELECT e.event_id, e.user_id, p.event_id AS purchase_id, p.value AS price FROM events e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts"""


def spread_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sketches of events merged into weeks, with whether ranks and distinct counts are within their bounds of the exact ones."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    daily = summaries.sketched(events, ["day", "event_type"], "value", "user_id")
    weekly = summaries.merged(daily, [F.date_trunc("week", "day").cast("date").alias("week"), "event_type"])
    shares = (0.25, 0.5, 0.75)
    found = summaries.spread(weekly, ["week", "event_type"], shares)
    rows = events.select(F.date_trunc("week", "day").cast("date").alias("week"), "event_type", "value", "user_id").join(F.broadcast(found), ["week", "event_type"])
    q = lambda i: F.col("quantiles")[i]
    checks = [F.sum((F.col("value") < q(i)).cast("int")).alias(f"below{i}") for i in range(3)] + [F.sum((F.col("value") <= q(i)).cast("int")).alias(f"upto{i}") for i in range(3)]
    exact = rows.groupBy("week", "event_type").agg(*checks, F.countDistinct("user_id").alias("users"), *[F.first(c).alias(c) for c in ("n", "mean", "low", "high", "distinct")])
    slack = F.col("n") * summaries.RANK_ERROR + 1
    ranks = reduce(lambda a, b: a & b, [(F.col(f"below{i}") <= F.col("n") * s + slack) & (F.col(f"upto{i}") >= F.col("n") * s - slack) for i, s in enumerate(shares)])
    near = F.abs(F.col("distinct") - F.col("users")) <= F.col("users") * 2 * summaries.DISTINCT_ERROR + 1
    return exact.select("week", "event_type", "n", F.round("mean", 6).alias("mean"), "low", "high", ranks.alias("ranks_within"), near.alias("distinct_within"))


SPREAD_SQL = """SELECT date_trunc('week', ts)::DATE AS week, event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, true AS ranks_within, true AS distinct_within
FROM events GROUP BY 1, 2"""

SIZES = (300, 600, 1200)


def metrics_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks under three sizes, by strategy, source and language and all their combinations."""
    docs = fixtures.documents(spark, sf)
    frames = [chunking.plain_chunks(docs, "fixed", chunking.SplitOptions(n, n // 10, 50), keep=["source", "lang"]).withColumn("strategy", F.lit(f"fixed_{n}")) for n in SIZES]
    rows = frames[0].unionByName(frames[1]).unionByName(frames[2])
    found = summaries.metrics_cube(rows, ["strategy", "source", "lang"], "length", {"broken": F.contains("text", F.lit("\n")), "cited": F.contains("text", F.lit(" the "))})
    return found.select("strategy", "source", "lang", "level", "n", "total", "low", "high", *[F.round(c, 6).alias(c) for c in ("mean", "broken_share", "cited_share")])


CUBE_SQL = "WITH t AS (" + " UNION ALL ".join(
    f"SELECT 'fixed_{n}' AS strategy, source, lang, substr(text, i * {n - n // 10} + 1, {n}) AS t FROM (SELECT *, unnest(range((length(text) + {n - n // 10 - 1}) // {n - n // 10})) AS i FROM documents)" for n in SIZES
) + """) SELECT strategy, source, lang, GROUPING(strategy, source, lang)::INT AS level, count(*) AS n, sum(length(t))::BIGINT AS total, min(length(t))::INT AS low, max(length(t))::INT AS high, round(sum(length(t))::DOUBLE / count(*), 6) AS mean,
round(count(*) FILTER (contains(t, chr(10)))::DOUBLE / count(*), 6) AS broken_share, round(count(*) FILTER (contains(t, ' the '))::DOUBLE / count(*), 6) AS cited_share
FROM t WHERE length(t) >= 50 GROUP BY CUBE (strategy, source, lang)"""

QUERIES = {
    "bm25_topk": (bm25_topk, f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank < 10"),
    "fused_topk": (fused_topk, FUSED_SQL),
    "chunk_elements": (chunk_elements, ELEMENTS_SQL),
    "asof_price": (asof_price, ASOF_SQL),
    "spread_by_period": (spread_by_period, SPREAD_SQL),
    "metrics_cube": (metrics_cube, CUBE_SQL),
}
