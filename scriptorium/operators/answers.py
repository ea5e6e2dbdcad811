"""Answers to questions: retrieval, prompt, chat model with a fallback, citations, as one transform with pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.models import Embedder, HashedWords, Reranker
from . import retrieval

#: Model id, prompt and temperature to an answer.
ChatModel = Callable[[str, str, float], str]

# What is said without sources, and before an answer of the fallback model.
NO_SOURCES = "I couldn't find any relevant sources to answer your question. Please try rephrasing or ask a different question."
FALLBACK = "[Using fallback model {model}]\n\n"


@dataclass(frozen=True)
class Retriever:
    """A searchable table with the models to search it: embedder, and reranker or none."""

    vectors: DataFrame
    embedder: Callable[[], Embedder] = HashedWords
    reranker: Callable[[], Reranker] | None = retrieval.overlap_model
    candidates: int = 75

    def search(self, questions: DataFrame, k: int = 10, rerank: bool = True) -> DataFrame:
        """Hits of questions (query_id, query): ``candidates`` by vector, then ``k`` by the reranker, or ``k`` by vector."""
        asked = retrieval.embed_queries(questions, self.embedder)
        wanted = rerank and self.reranker is not None
        hits = retrieval.search(self.vectors, asked, k=self.candidates if wanted else k, candidates=max(k, self.candidates) if wanted else k)
        return retrieval.rerank(hits, k, self.reranker) if wanted else hits

    def health(self) -> dict:
        """What is loaded."""
        kinds = [r["chunk_type"] for r in self.vectors.select("chunk_type").distinct().orderBy("chunk_type").limit(2).collect()] if "chunk_type" in self.vectors.columns else []
        return {"status": "ok", "index_loaded": True, "index_size": self.vectors.count(), "chunk_type": "/".join(kinds)}


def create_retriever(vectors: DataFrame, embedder: Callable[[], Embedder] | None = HashedWords, reranker: Callable[[], Reranker] | None = None) -> Retriever:
    """A retriever over a searchable table; ValueError without an embedder."""
    if embedder is None:
        raise ValueError("a retriever needs an embedder")
    return Retriever(vectors, embedder, reranker)


def answer(prompts: DataFrame, chat: Callable[[], ChatModel], default: str = retrieval.DEFAULT_MODEL) -> DataFrame:
    """Adds ``answer``, ``answered_by`` and ``error`` to rows with ``prompt`` and ``model``.

    Where the model fails the default one is asked, and its answer says so; where that fails too the answer is null and the
    error says what both said. A row without prompt has the answer for a question without sources.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema), "answer string, answered_by string, error string"])

    def temperature(model: str) -> float:
        return 1.0 if "gpt-5" in model else 0.3

    def one(call: ChatModel, prompt: str | None, model: str) -> tuple[str | None, str | None, str | None]:
        if prompt is None:
            return NO_SOURCES, None, None
        try:
            return call(model, prompt, temperature(model)), model, None
        except Exception as error:
            first = f"{model}: {type(error).__name__}: {error}"
        if model == default:
            return None, None, first
        try:
            return FALLBACK.format(model=default) + call(default, prompt, temperature(default)), default, first
        except Exception as error:
            return None, None, f"{first}; {default}: {type(error).__name__}: {error}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = chat()
        for frame in frames:
            got = [one(call, p, m) for p, m in zip(frame["prompt"], frame["model"], strict=True)]
            yield frame.assign(answer=[g[0] for g in got], answered_by=[g[1] for g in got], error=[g[2] for g in got])

    return prompts.mapInPandas(run, schema)


def answers(questions: DataFrame, retriever: Retriever, chat: Callable[[], ChatModel], k: int = 10, rerank: bool = True, catalogue: DataFrame | None = None) -> DataFrame:
    """(query_id, query, model, answer, answered_by, error, sources_used, citations) of questions (query_id, query, model or null).

    Blank questions and unknown models have no row, see :func:`retrieval.valid_requests`. Citations are the papers of the hits in rank
    order, so they don't depend on the answer.
    """
    catalogue = retrieval.models(questions.sparkSession) if catalogue is None else catalogue
    asked = retrieval.valid_requests(questions, catalogue).select("query_id", "query", "model")
    hits = retriever.search(asked.select("query_id", "query"), k, rerank)
    prompt = retrieval.prompts(hits).select("query_id", "prompt")
    used = hits.groupBy("query_id").agg(F.count("*").alias("sources_used"))
    fields = F.struct("id", "paper_id", "title", "authors", "year", "snippet")
    cited = retrieval.citations(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(fields)).alias("citations"))
    rows = answer(asked.join(prompt, "query_id", "left"), chat).drop("prompt")
    out = rows.join(used, "query_id", "left").join(cited, "query_id", "left")
    return out.withColumns({"sources_used": F.coalesce("sources_used", F.lit(0)), "citations": F.coalesce("citations", F.array().cast(cited.schema["citations"].dataType))})
