"""Search and answers over HTTP, for one searchable table that is loaded at start, and a client for it.

A request is a small query set that runs as one Spark job; many questions at once are for :func:`..operators.answers.answers`.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession

from .operators import answers, retrieval

HITS = ["chunk_id", "paper_id", "paper_title", "text", "section_hierarchy", "score", "rank"]


class Refused(Exception):
    """A request that isn't answered: status and reason."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status, self.reason = status, reason


@dataclass
class Service:
    """Routes of the API as functions of a request's body. ``load`` keeps the table in the executors' memory until ``close``."""

    spark: SparkSession
    retriever: answers.Retriever | None = None
    chat: Callable[[], answers.ChatModel] | None = None

    def load(self, vectors: DataFrame, **models: object) -> Service:
        self.retriever = answers.create_retriever(vectors.cache(), **models)
        return self

    def close(self) -> None:
        if self.retriever:
            self.retriever.vectors.unpersist()
            self.retriever = None

    def root(self, _: dict) -> dict:
        return {"message": "Search API", "models": "/models", "health": "/health"}

    def health(self, _: dict) -> dict:
        return self.retriever.health() if self.retriever else {"status": "ok", "index_loaded": False, "index_size": 0, "chunk_type": ""}

    def models(self, _: dict) -> dict:
        rows = retrieval.models(self.spark).collect()
        return {"models": [r.asDict() for r in rows], "default": retrieval.DEFAULT_MODEL}

    def _ready(self, question: str) -> answers.Retriever:
        if not self.retriever:
            raise Refused(503, "no index is loaded")
        if not question.strip():
            raise Refused(400, "the question is empty")
        return self.retriever

    def search(self, body: dict) -> dict:
        """``query``, ``top_k`` (10), ``use_reranker`` (true) to results."""
        question, began = str(body.get("query") or ""), time.perf_counter()
        retriever = self._ready(question)
        asked = self.spark.createDataFrame([(0, question)], "query_id int, query string")
        hits = retriever.search(asked, int(body.get("top_k", 10)), bool(body.get("use_reranker", True)))
        shown = [c for c in HITS if c in hits.columns]
        results = [r.asDict(recursive=True) for r in hits.orderBy("rank").select(*shown).collect()]
        return {"query": question, "results": results, "total_results": len(results), "elapsed_ms": round((time.perf_counter() - began) * 1000, 2)}

    def answer(self, body: dict) -> dict:
        """``message``, ``top_k``, ``use_reranker``, ``model`` to an answer with citations."""
        question, began = str(body.get("message") or ""), time.perf_counter()
        retriever = self._ready(question)
        if self.chat is None:
            raise Refused(503, "no chat model is configured")
        asked = self.spark.createDataFrame([(0, question, body.get("model"))], "query_id int, query string, model string")
        row = answers.answers(asked, retriever, self.chat, int(body.get("top_k", 10)), bool(body.get("use_reranker", True))).first()
        if row is None:
            raise Refused(400, f"unknown model: {body.get('model')}")
        if row["answer"] is None:
            raise Refused(503, row["error"])
        cited = [c.asDict() for c in row["citations"]]
        return {"message": question, "answer": row["answer"], "sources_used": row["sources_used"], "citations": cited, "elapsed_ms": round((time.perf_counter() - began) * 1000, 2)}

    def handle(self, method: str, path: str, body: dict) -> tuple[int, dict]:
        """Status and answer of a request."""
        routes = {("GET", "/"): self.root, ("GET", "/health"): self.health, ("GET", "/models"): self.models, ("POST", "/search"): self.search, ("POST", "/chat"): self.answer}
        if (method, path) not in routes:
            return 404, {"detail": f"no {method} {path}"}
        try:
            return 200, routes[method, path](body)
        except Refused as refused:
            return refused.status, {"detail": refused.reason}

    def server(self, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
        """A server, not yet serving; port 0 takes a free one."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _reply(self) -> None:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                try:
                    status, found = service.handle(self.command, self.path.split("?")[0], json.loads(raw or b"{}"))
                except ValueError as error:
                    status, found = 400, {"detail": str(error)}
                data = json.dumps(found, ensure_ascii=False).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = _reply

            def log_message(self, *_: object) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)


def search_documents(url: str, query: str, top_k: int = 10, use_reranker: bool = True) -> dict:
    """Asks a server for hits."""
    body = json.dumps({"query": query, "top_k": top_k, "use_reranker": use_reranker}).encode()
    with urlopen(Request(f"{url}/search", body, {"Content-Type": "application/json"}), timeout=120) as f:
        return json.load(f)
