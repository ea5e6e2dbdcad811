"""Queries over ``embeddings``: search, reranking, citations, prompts, normalisation, coherence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import normalize_score
from ..functions.vectors import cosine, mean_cosine, norm, normalized
from ..operators import retrieval, vector_index
from ..sources.files import table
from . import fixtures

#: Scores are compared after rounding, as sums are taken in another order.
HITS_SQL = """h AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM h)"""


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.top_k(table(spark, sf, "embeddings"), fixtures.queries(spark, sf), 10)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def vector_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same hits from a stored index, queries dealt as rows."""
    index = vector_index.build(table(spark, sf, "embeddings"))
    hits = vector_index.search(index, fixtures.queries(spark, sf), 10)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def vector_index_reached(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the index's cells each query is compared with, at a threshold that few vectors reach."""
    index = vector_index.build(table(spark, sf, "embeddings"))
    return vector_index.reached(index, fixtures.queries(spark, sf), 10, threshold=0.3)


def vector_threshold(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.top_k(table(spark, sf, "embeddings"), fixtures.queries(spark, sf), 10, threshold=0.3)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def vector_two_phase(spark: SparkSession, sf: str) -> DataFrame:
    by_label = lambda hits: hits.withColumn("score", F.round("score", 6) - F.col("label") * 0.01)
    hits = retrieval.search(table(spark, sf, "embeddings"), fixtures.queries(spark, sf), k=10, candidates=75, rerank_with=by_label)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def vector_normalize(spark: SparkSession, sf: str) -> DataFrame:
    scaled = table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3)))
    return scaled.select("vec_id", F.round(norm("v"), 5).alias("norm"), F.round(norm(normalized("v")), 5).alias("unit"))


def label_coherence(spark: SparkSession, sf: str) -> DataFrame:
    found = mean_cosine(table(spark, sf, "embeddings"), "label")
    return found.where("vectors > 1").select("label", "vectors", F.round("coherence", 6).alias("coherence"))


def cosine_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(cosine("embedding", "next"), 6).alias("cosine"))


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with a paper for each label and a text for each vector."""
    hits = retrieval.top_k(table(spark, sf, "embeddings"), fixtures.queries(spark, sf), 20).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.substring_index("text", " ", 2).alias("section"))
    return hits.join(texts, "vec_id").select(
        "query_id", F.concat(F.lit("question "), "query_id").alias("query"), "rank", F.format_string("P%03d", "label").alias("paper_id"),
        F.concat(F.lit("Paper "), F.col("label"), F.lit("\nline")).alias("paper_title"), F.array(F.lit("A"), F.col("section")).alias("section_hierarchy"), F.round("score", 6).alias("score"), "text",
    )


PAPERS_SQL = f"""{HITS_SQL}, p AS (SELECT query_id, 'question ' || query_id AS query, rank, printf('P%03d', label) AS paper_id, 'Paper ' || label AS title,
    'A > ' || array_to_string(string_split(text, ' ')[1:2], ' ') AS section, round(score, 6) AS score, text FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE rank < 20)"""


def citations_first_per_paper(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.citations(_papers(spark, sf)).withColumn("id", F.col("id").cast("long"))


def prompt_sources(spark: SparkSession, sf: str) -> DataFrame:
    out = retrieval.prompts(_papers(spark, sf), "S:{sources}\nQ:{question}")
    return out.select("query_id", F.md5("sources").alias("sources"), F.md5("prompt").alias("prompt"), F.length("sources").cast("long").alias("length"))


def min_max_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))
    ends = e.groupBy("label").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    j = e.join(ends, "label")
    return j.select("vec_id", F.round(normalize_score(F.col("x"), F.col("low"), F.col("high")), 6).alias("score"), F.round(normalize_score(F.col("x"), F.col("low"), F.col("high"), True), 6).alias("inverted"))


def hashed_embedding_search(spark: SparkSession, sf: str) -> DataFrame:
    """Texts embedded by the offline default, searched with benchmark items, reranked by shared words."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    indexed = retrieval.index(docs)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = retrieval.search(indexed, retrieval.embed_queries(items), k=10, candidates=75)
    return retrieval.rerank(hits, 5).select("query_id", "chunk_id", "score", F.col("rank").cast("long"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests: each names a model of the catalogue, an unknown one, or none."""
    named = F.element_at(F.array(*[F.lit(m[0]) for m in retrieval.MODELS], F.lit("unknown"), F.lit(None)), (1 + F.col("event_id") % (len(retrieval.MODELS) + 2)).cast("int"))
    return retrieval.valid_requests(table(spark, sf, "events").select(F.col("event_type").alias("query"), named.alias("model")), retrieval.models(spark))


def model_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue with the number of valid requests for each model."""
    asked = _asked(spark, sf).groupBy(F.col("model").alias("id")).agg(F.count("*").alias("requests"))
    found = retrieval.models(spark).join(asked, "id", "left")
    return found.select("id", "tier", "context", "is_default", retrieval.temperature("id").alias("temperature"), F.coalesce("requests", F.lit(0)).alias("requests"))


MODELS_SQL = """WITH m(id, tier, context) AS (VALUES {1}), r AS (SELECT CASE WHEN event_id % {3} = {3} - 1 THEN '{0}' ELSE [{2}, 'unknown'][1 + event_id % {3}] END AS id FROM events WHERE trim(event_type) <> '')
SELECT id, tier, context, id = '{0}' AS is_default, CASE WHEN contains(id, 'gpt-5') THEN 1.0 ELSE 0.3 END::DOUBLE AS temperature, (SELECT count(*) FROM r WHERE r.id = m.id) AS requests FROM m""".format(
    retrieval.DEFAULT_MODEL, ", ".join(f"('{m[0]}', '{m[3]}', {m[4]})" for m in retrieval.MODELS), ", ".join(f"'{m[0]}'" for m in retrieval.MODELS), len(retrieval.MODELS) + 2
)


def models_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    """Tiers with their models and the number of valid requests for these."""
    catalogue = retrieval.models(spark)
    asked = _asked(spark, sf).join(F.broadcast(catalogue.select(F.col("id").alias("model"), "tier")), "model").groupBy("tier").agg(F.count("*").alias("requests"))
    grouped = retrieval.models_by_tier(catalogue).join(asked, "tier", "left")
    return grouped.select("tier", F.array_join("models", ",").alias("models"), F.coalesce("requests", F.lit(0)).alias("requests"))


TIERS_SQL = f"SELECT tier, string_agg(id, ',' ORDER BY id) AS models, sum(requests)::BIGINT AS requests FROM ({MODELS_SQL}) GROUP BY tier"

QUERIES = {
    "vector_topk": (vector_topk, f"WITH {HITS_SQL} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank < 10"),
    "vector_index_topk": (vector_index_topk, f"WITH {HITS_SQL} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank < 10"),
    "vector_index_reached": (vector_index_reached, None),
    "vector_threshold": (vector_threshold, f"WITH {HITS_SQL} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank < 10 AND score >= 0.3"),
    "vector_two_phase": (vector_two_phase, f"""WITH {HITS_SQL}, c AS (SELECT query_id, vec_id, round(score, 6) - label * 0.01::DOUBLE AS score FROM r WHERE rank < 75),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM c)
        SELECT query_id, vec_id, round(score, 6) AS score, rank FROM n WHERE rank < 10"""),
    "vector_normalize": (vector_normalize, "SELECT vec_id, round((vec_id % 3) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS unit FROM embeddings"),
    "label_coherence": (label_coherence, """WITH p AS (SELECT a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
        SELECT p.label, n.n AS vectors, round(avg(c), 6) AS coherence FROM p JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) n ON n.label = p.label GROUP BY p.label, n.n"""),
    "cosine_neighbours": (cosine_neighbours, "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    "citations_first_per_paper": (citations_first_per_paper, f"""WITH {PAPERS_SQL}, f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) = 1)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS id, paper_id, title, paper_id AS authors, '' AS year, substr(text, 1, 150) || '...' AS snippet FROM f"""),
    "prompt_sources": (prompt_sources, f"""WITH {PAPERS_SQL}, s AS (SELECT query_id, query, string_agg(chr(10) || '### Source ' || (rank + 1) || ': ' || title || chr(10) || '**Section**: ' || section || chr(10)
        || '**Relevance Score**: ' || printf('%.2f%%', score * 100) || chr(10) || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS s FROM p GROUP BY ALL)
        SELECT query_id, md5(s) AS sources, md5('S:' || s || chr(10) || 'Q:' || query) AS prompt, length(s) AS length FROM s"""),
    "min_max_scores": (min_max_scores, """WITH e AS (SELECT label, vec_id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings), m AS (SELECT *, min(x) OVER w AS low, max(x) OVER w AS high FROM e WINDOW w AS (PARTITION BY label))
        SELECT vec_id, round(CASE WHEN low = high THEN 0.5 ELSE (x - low) / (high - low) END, 6) AS score, round(CASE WHEN low = high THEN 0.5 ELSE 1 - (x - low) / (high - low) END, 6) AS inverted FROM m"""),
    "hashed_embedding_search": (hashed_embedding_search, None),
    "model_catalogue": (model_catalogue, MODELS_SQL),
    "models_by_tier": (models_by_tier, TIERS_SQL),
}
