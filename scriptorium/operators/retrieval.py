"""Vector retrieval: exact top-k, two-phase search with a reranker, context, prompts and citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.models import HashedWords, Reranker, embed, overlap_reranker, rerank_scores
from ..functions.text import decimals, strip
from ..functions.vectors import dot, normalized
from ..scratch import stored

#: Bytes of a block of queries for one pass over the vectors, their hits in a task included.
QUERY_BYTES = 64 << 20
#: Scores of queries of a block and vectors of a batch that a task has at once.
SCORES = 1 << 20

# Fixed value: the frame of a prompt.
PROMPT = """Based on the following academic sources, answer the user's policy question.

## Retrieved Sources
{sources}

## User Question
{question}

## Instructions
1. Synthesize the sources to answer the question
2. Structure your response with: Executive Summary, Detailed Analysis, **Policy Implications**, Key References
3. **Be quantitative**: Include effect sizes, percentages, statistical significance when sources provide them
4. **Be specific**: Cite which papers (Source 1, Source 2, etc.) support which claims
5. **Show evidence quality**: Label findings as "Strong evidence", "Moderate evidence", or "Limited evidence"
6. **Context-dependent findings**: Highlight when results vary by sector, country, or time period
7. Acknowledge if the sources don't fully answer the question
8. Respond in the same language as the question

Your response:"""

# The chat models on offer: id, name, provider, tier, context length, description.
MODELS = [
    ("openrouter/openai/gpt-5-mini", "GPT-5 Mini", "OpenAI", "fast", 128000, "Fast & cost-effective, multimodal"),
    ("openrouter/google/gemini-3-pro-preview", "Gemini 3 Pro Preview", "Google", "fast", 65500, "Ultra-fast inference"),
    ("openrouter/openai/gpt-5o", "GPT-5o", "OpenAI", "fast", 128000, "Full GPT-5o model, more capable than mini"),
    ("openrouter/anthropic/claude-3.5-sonnet", "Claude 3.5 Sonnet", "Anthropic", "balanced", 200000, "Excellent reasoning & coding"),
    ("openrouter/google/gemini-2.5-pro", "Gemini 2.5 Pro", "Google", "balanced", 1000000, "Top performance, massive context"),
    ("openrouter/deepseek/deepseek-chat", "DeepSeek Chat", "DeepSeek", "balanced", 64000, "Strong open-source option"),
    ("openrouter/anthropic/claude-sonnet-4.5", "Claude Sonnet 4.5", "Anthropic", "premium", 200000, "Latest flagship, complex reasoning"),
    ("openrouter/deepseek/deepseek-r1", "DeepSeek R1", "DeepSeek", "premium", 64000, "Top Arena performance"),
    ("openrouter/qwen/qwen-2.5-72b-instruct", "Qwen 2.5 72B", "Qwen", "premium", 128000, "Excellent technical content"),
]
DEFAULT_MODEL = MODELS[0][0]


def ranked(scores: DataFrame, k: int, by: str = "query_id", tie: str = "vec_id") -> DataFrame:
    """The ``k`` best rows of each group by score, then by ``tie``, with ``rank`` from 0."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), tie))
    return scores.withColumn("_n", place).where(F.col("_n") <= k).withColumn("rank", F.col("_n") - 1).drop("_n")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 50, threshold: float | None = None, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Exact inner-product search: (query_id, vec_id, score, rank) of the ``k`` best vectors for each query.

    Queries (query_id, vector) are the stated set, searched against all vectors. Blocks of queries of ``QUERY_BYTES``
    go to the executors one after another (the driver has one block at a time; for more queries than a few blocks see
    :mod:`.vector_index`, where queries are rows); each task multiplies its vectors with a block batch by batch and keeps k rows for each query, so the
    shuffle has k rows for each task and query at most. A ``threshold`` drops lower scores first. Null vectors have no score.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    base = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("v"))
    schema = f"query_id {query_type}, vec_id {id_type}, score double"
    found = spark.createDataFrame([], schema)
    extent = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
    per_query = max(8 * (extent["size"] or 1), 24 * k)  # a vector in the block, and k scores with ids and queries in a task
    blocks = -(-extent["n"] * per_query // QUERY_BYTES)
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.toArrow()
        if not rows.num_rows:
            continue
        keys, matrix = rows["query_id"].combine_chunks(), _matrix(rows["v"].combine_chunks())
        near = ranked(base.mapInArrow(_nearest(keys, matrix, k, threshold), schema), k).drop("rank")
        found = near if blocks == 1 else found.unionByName(stored(near, "hits"))  # done before the next block is fetched
    return ranked(found, k)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _codes(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids."""
    return np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids


def _kept(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hits (query, score, id), the ``k`` best of each query by score, then by id."""
    order = np.lexsort((_codes(ids), -score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return query[place < k], score[place < k], ids[place < k]


def _nearest(keys: pa.Array, queries: np.ndarray, k: int, threshold: float | None) -> Callable:
    """A task's best vectors for each query. One product for a batch finds who may be among them; their scores are summed anew,
    one by one in the same order, so equal vectors have equal scores and ties go by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_queries = len(queries)
        least = np.full(n_queries, -np.inf if threshold is None else threshold)
        length = np.sqrt((queries**2).sum(axis=1))
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors, ids = _matrix(batch.column(1)), batch.column(0).to_pandas().to_numpy()
            slack = 1e-12 * (1 + length * np.sqrt((vectors**2).sum(axis=1).max()))
            step = max(1, SCORES // n)
            for at in range(0, n_queries, step):
                part = slice(at, at + step)
                scores = queries[part] @ vectors.T
                bound = least[part] if n <= k else np.maximum(least[part], np.partition(scores, n - k, axis=1)[:, n - k])
                q, v = np.nonzero(scores >= (bound - slack[part])[:, None])
                exact = np.einsum("nd,nd->n", queries[q + at], vectors[v])
                good = exact >= least[q + at] if threshold is not None else slice(None)
                hits.append((q[good] + at, exact[good], ids[v[good]]))
            query, score, own = _kept(*(np.concatenate([h[i] for h in hits]) for i in range(3)), k)
            hits = [(query, score, own)]
            full = np.flatnonzero(np.bincount(query, minlength=n_queries) == k)
            least[full] = score[np.searchsorted(query, full, side="right") - 1]
        if hits:
            query, score, own = hits[0]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(query)), pa.array(own), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def similarity(a: Column | str, b: Column | str) -> Column:
    return dot(a, b)


def embed_queries(queries: DataFrame, model: Callable = HashedWords, text_col: str = "query") -> DataFrame:
    """Adds ``vector``: the normalised embedding."""
    return queries.withColumn("_v", embed(text_col, model)).withColumn("vector", normalized("_v")).drop("_v")


def index(chunks: DataFrame, model: Callable = HashedWords, batch: int = 100) -> DataFrame:
    """Chunks with ``vec_id`` (the chunk's id, a stable key) and the normalised ``embedding``: the searchable table."""
    return chunks.withColumn("_v", embed("text", model, batch)).select("*", F.col("chunk_id").alias("vec_id"), normalized("_v").cast("array<float>").alias("embedding")).drop("_v")


def overlap_model() -> Reranker:
    """The reranker that needs no network."""
    return overlap_reranker


def rerank(candidates: DataFrame, k: int = 10, model: Callable[[], Reranker] = overlap_model, query_col: str = "query", text_col: str = "text", tie: str = "vec_id") -> DataFrame:
    """Scores candidates anew, keeps ``k`` for each query and numbers them from 0; a null score keeps the old one."""
    scored = candidates.withColumn("score", F.coalesce(rerank_scores(query_col, text_col, model), "score"))
    return ranked(scored.drop("rank"), k, tie=tie)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, candidates: int = 75, rerank_with: Callable[[DataFrame], DataFrame] | None = None, id_col: str = "vec_id") -> DataFrame:
    """Two phases: ``candidates`` by vectors, then ``k`` by ``rerank_with`` (a function of the hits that sets ``score``), or cut.

    With more wanted than candidates, the candidates are all there is. Hits carry the columns of both tables.
    """
    hits = top_k(vectors, queries, candidates, id_col=id_col)
    carried = hits.join(vectors.withColumnRenamed(id_col, "vec_id").drop("embedding"), "vec_id").join(queries.drop("vector"), "query_id")
    if rerank_with is None:
        return carried.where(F.col("rank") < k)
    return ranked(rerank_with(carried).drop("rank"), k)


def with_context(hits: DataFrame, chunks: DataFrame, window: int = 0) -> DataFrame:
    """Hits with ``context``: the texts of the chunks up to ``window`` places before and after in the same paper and type, in order."""
    around = hits.select("query_id", "rank", "paper_id", "chunk_type", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    found = around.join(chunks.select("paper_id", "chunk_type", "chunk_index", F.col("text").alias("_t")), ["paper_id", "chunk_type", "chunk_index"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "_t"))), lambda x: x["_t"])
    return hits.join(found.groupBy("query_id", "rank").agg(texts.alias("context")), ["query_id", "rank"], "left")


def fine_of_coarse(hits: DataFrame, fine: DataFrame) -> DataFrame:
    """Fine chunks of the coarse chunks that were hit, by ``parent_chunk_id``."""
    parents = hits.select("query_id", "rank", "score", F.col("chunk_id").alias("parent_chunk_id"))
    return fine.join(parents, "parent_chunk_id")


def source_block(place: Column, title: Column, hierarchy: Column, score: Column, text: Column) -> Column:
    """One numbered source of a prompt."""
    return F.concat(
        F.lit("\n### Source "), place.cast("string"), F.lit(": "), F.substring_index(title, "\n", 1), F.lit("\n**Section**: "), F.array_join(hierarchy, " > "),
        F.lit("\n**Relevance Score**: "), decimals(score * 100, 2), F.lit("%"), F.lit("\n\n"), text, F.lit("\n"),
    )


def prompts(hits: DataFrame, template: str = PROMPT) -> DataFrame:
    """(query_id, sources, prompt): a query's hits (query, rank, paper_title, section_hierarchy, score, text) as numbered sources in a prompt."""
    block = source_block(F.col("rank") + 1, F.col("paper_title"), F.col("section_hierarchy"), F.col("score"), F.col("text"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])
    sources = hits.groupBy("query_id", "query").agg(F.array_join(blocks, "\n---\n").alias("sources"))
    filled = F.replace(F.replace(F.lit(template), F.lit("{sources}"), F.col("sources")), F.lit("{question}"), F.col("query"))
    return sources.select("query_id", "sources", filled.alias("prompt"))


def citations(hits: DataFrame) -> DataFrame:
    """Each paper's first hit for a query, in rank order, as (query_id, id, paper_id, title, authors, year, snippet).

    ``title`` is the first line's first 100 characters, ``snippet`` the text's first 150 and ``...``; ``authors`` holds the
    paper id and ``year`` is empty, as hits carry neither.
    """
    first = Window.partitionBy("query_id", "paper_id").orderBy("rank")
    kept = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.select(
        "query_id", place.alias("id"), "paper_id", F.substring(F.substring_index("paper_title", "\n", 1), 1, 100).alias("title"),
        F.col("paper_id").alias("authors"), F.lit("").alias("year"), F.concat(F.substring("text", 1, 150), F.lit("...")).alias("snippet"),
    )


def models(spark) -> DataFrame:
    """The catalogue of chat models."""
    return spark.createDataFrame(MODELS, "id string, name string, provider string, tier string, context int, description string").withColumn("is_default", F.col("id") == DEFAULT_MODEL)


def models_by_tier(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("tier").agg(F.array_sort(F.collect_list("id")).alias("models"))


def valid_requests(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requests with a question that isn't blank and a known model; the catalogue's default where none is named."""
    chosen = requests.withColumn("model", F.coalesce("model", F.lit(DEFAULT_MODEL))).where(strip("query") != "")
    return chosen.join(F.broadcast(catalogue.select(F.col("id").alias("model"))), "model", "left_semi")


def temperature(model: Column | str) -> Column:
    return F.when(F.contains(F.col(model) if isinstance(model, str) else model, F.lit("gpt-5")), F.lit(1.0)).otherwise(F.lit(0.3))
