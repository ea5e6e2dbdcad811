"""Model calls as pluggable batch functions, with deterministic defaults that need no network.

An embedder takes a list of texts and returns a float32 matrix; a reranker takes queries and texts
and returns scores; a page model takes images and prompts and returns strings. Each runs in Arrow batches, once loaded per
worker. :func:`retrying` and :func:`halving` give a remote model patience, :func:`or_original` gives a reranker a way out, and a
:class:`ModelHandle` loads once and can be unloaded.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, functions as F

from ..errors import ModelLoadError

Embedder = Callable[[list[str]], np.ndarray]
Reranker = Callable[[list[str], list[str]], list[float]]
PageModel = Callable[[list[bytes], list[str]], list[str]]


class HashedWords:
    """Embeds a text as its hashed words' counts, signed and L2-normalised; no words, the zero vector."""

    #: Words whose places are remembered.
    MOST_WORDS = 200_000

    def __init__(self, size: int = 256):
        self.size = size
        self.places: dict[str, int] = {}

    def _place(self, word: str) -> int:
        """A word's column, past ``size`` where it counts negative."""
        if len(self.places) >= self.MOST_WORDS:
            self.places.clear()
        h = xxhash.xxh3_64_intdigest(word)
        place = self.places[word] = (h >> 1) % self.size + (0 if h & 1 else self.size)
        return place

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts, strict=True):
            known = self.places.get
            places = [p if (p := known(word)) is not None else self._place(word) for word in (text or "").lower().split()]
            counts = np.bincount(np.array(places, np.int64), minlength=2 * self.size)
            row[:] = counts[: self.size] - counts[self.size :]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


def overlap_reranker(queries: list[str], texts: list[str]) -> list[float]:
    """The share of a query's distinct words that a text has."""
    scores = []
    for query, text in zip(queries, texts, strict=True):
        words = set((query or "").lower().split())
        scores.append(len(words & set((text or "").lower().split())) / len(words) if words else 0.0)
    return scores


def batched(texts: list[str], call: Embedder, size: int = 100) -> np.ndarray:
    """Calls an embedder that takes ``size`` texts at most."""
    parts = [call(texts[i : i + size]) for i in range(0, len(texts), size)]
    return np.concatenate(parts) if parts else np.empty((0, 0), np.float32)


def retrying(call: Callable, attempts: int = 3, wait: float = 4.0, most_wait: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried ``attempts`` times, with a wait that doubles up to ``most_wait`` seconds; the last error goes on."""

    def run(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except Exception:
                if attempt == attempts - 1:
                    raise
                sleep(min(most_wait, wait * 2**attempt))

    return run


def halving(call: Embedder) -> Embedder:
    """An embedder that, where a batch fails, tries its halves, down to single texts; a single text's error goes on."""

    def run(texts: list[str]) -> np.ndarray:
        try:
            return call(texts)
        except Exception:
            if len(texts) < 2:
                raise
            middle = len(texts) // 2
            return np.concatenate([run(texts[:middle]), run(texts[middle:])])

    return run


def or_original(call: Reranker) -> Callable[[list[str], list[str]], list[float | None]]:
    """A reranker whose failure gives no scores, so :func:`..operators.retrieval.rerank` keeps the scores and the order from before."""

    def run(queries: list[str], texts: list[str]) -> list[float | None]:
        try:
            return call(queries, texts)
        except Exception:
            return [None] * len(texts)

    return run


class ModelHandle:
    """A page model that is loaded by ``loader`` when it is first asked, once, and can be unloaded."""

    def __init__(self, loader: Callable[[], PageModel]):
        self.loader, self._model = loader, None

    @property
    def is_loaded(self) -> bool:
        return self._model is not None

    def load(self) -> None:
        if self._model is None:
            try:
                self._model = self.loader()
            except Exception as error:
                raise ModelLoadError(f"{type(error).__name__}: {error}") from error

    def unload(self) -> None:
        self._model = None

    def __call__(self, images: Sequence[bytes], prompts: Sequence[str]) -> list[str]:
        if len(images) != len(prompts):
            raise ValueError("an image for each prompt")
        self.load()
        return list(self._model(list(images), list(prompts)))

    def chat(self, prompt: str | list[str], image: bytes | list[bytes]) -> str | list[str]:
        """One prompt and image to a string, lists to a list."""
        return self([image], [prompt])[0] if isinstance(prompt, str) else self(image, prompt)


def embed(text: Column | str, model: Callable[[], Embedder] = HashedWords, batch: int = 100) -> Column:
    """``array<float>`` for each text; ``model`` makes the embedder, once for each worker task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = model()
        for texts in batches:
            yield pd.Series(list(batched(texts.fillna("").tolist(), call, batch)), index=texts.index, dtype=object)

    return run(F.col(text) if isinstance(text, str) else text)


def _unit_rows(texts: list[str], call: Embedder) -> np.ndarray:
    """Unit vectors of texts, each distinct text embedded once; zero vectors stay."""
    distinct = list(dict.fromkeys(texts))
    place = {t: i for i, t in enumerate(distinct)}
    vectors = batched(distinct, call).astype(float)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)[[place[t] for t in texts]]


def sentence_coherence(sentences: Column | str, model: Callable[[], Embedder] = HashedWords, least: int = 2) -> Column:
    """Mean cosine of all pairs of different sentences of an array; 1 below ``least``.

    From one sum of unit vectors for each row: (|sum|^2 - n) / (n (n - 1)), without pairs.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = model()
        for rows in batches:
            lists = [list(r) if r is not None else [] for r in rows]
            flat = [t for r in lists for t in r]
            unit = _unit_rows(flat, call) if flat else np.zeros((0, 1))
            out, at = [], 0
            for r in lists:
                u, at, n = unit[at : at + len(r)], at + len(r), len(r)
                total = u.sum(axis=0)
                out.append(1.0 if n < max(2, least) else float((total @ total - (u * u).sum()) / (n * (n - 1))))
            yield pd.Series(out, index=rows.index)

    return run(F.col(sentences) if isinstance(sentences, str) else sentences)


def row_dots(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from left to right with one rounding for each product and its sum.

    So does DuckDB's ``list_dot_product``; numpy rounds twice, and a cosine's last bit decides where rounding to some places is nearly a tie.
    """
    dots = [0.0] * len(u)
    for a, b in zip(u.T.tolist(), v.T.tolist(), strict=True):
        dots = list(map(math.fma, a, b, dots))
    return np.array(dots, float)


def text_cosine(a: Column | str, b: Column | str, model: Callable[[], Embedder] = HashedWords) -> Column:
    """Cosine of two texts' embeddings; null where either is zero."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        call = model()
        for left, right in batches:
            if not len(left):
                yield pd.Series([], dtype=float)
                continue
            unit = _unit_rows(left.fillna("").tolist() + right.fillna("").tolist(), call)
            u, v = unit[: len(left)], unit[len(left) :]
            yield pd.Series(np.where((u != 0).any(1) & (v != 0).any(1), row_dots(u, v), np.nan), index=left.index)

    return run(*(F.col(c) if isinstance(c, str) else c for c in (a, b)))


def rerank_scores(query: Column | str, text: Column | str, model: Callable[[], Reranker] = lambda: overlap_reranker) -> Column:
    """A relevance score for each pair of query and text."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        call = model()
        for queries, texts in batches:
            yield pd.Series(call(queries.fillna("").tolist(), texts.fillna("").tolist()), index=texts.index, dtype=float)

    return run(*(F.col(c) if isinstance(c, str) else c for c in (query, text)))


def count_tokens(text: Column | str, encode: Callable[[], Callable[[str], list]] | None = None) -> Column:
    """Tokens by a tokenizer's encoder; without one, a quarter of the characters."""
    from .names import token_estimate

    if encode is None:
        return token_estimate(text)

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = encode()
        for texts in batches:
            yield pd.Series([len(call(t or "")) for t in texts], index=texts.index)

    return run(F.col(text) if isinstance(text, str) else text)
