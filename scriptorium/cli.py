"""Command line: ``python -m scriptorium.cli <command>``; every command is a read, a transform and a write."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import logging
import logging.handlers
import platform
from urllib.request import urlopen

from pyspark.sql import SparkSession, functions as F

from .functions import names
from .operators import answers, chunking, evaluation, operations, parsing, reports, retrieval, works
from .scratch import stored
from .session import session
from .sources import files, sinks
from .sources.files import spread
from .sources.works_api import RangesSource, WorksSource, unfinished


def fetch_works(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reads works from the API or saved pages and writes flat works and their summary."""
    ranges = a.first is not None and a.last is not None
    for source in (WorksSource, RangesSource):
        spark.dataSource.register(source)
    reader = spark.read.format("works_ranges" if ranges or a.resume else "works_pages").option("filter", a.filter).option("per_page", str(a.per_page))
    for key in ("url", "email", "pages", "cursor", "field", "first", "last", "most"):
        if (value := getattr(a, key)) is not None:
            reader = reader.option(key, str(value))
    if a.resume:  # an earlier read's ranges that failed; what it has stays
        if not (left := unfinished(spark.read.parquet(f"{a.output}/pages"))):
            raise SystemExit("complete: nothing to go on with")
        reader = reader.option("resume", left)
        kept = stored(spark.read.parquet(f"{a.output}/pages").where("json IS NOT NULL"), "pages-before")
        found = stored(reader.load(), "pages-resumed")
        sinks.write_parquet(kept.unionByName(found), f"{a.output}/pages")
    else:
        sinks.write_parquet(reader.load(), f"{a.output}/pages")  # read once: the source is remote
    read = spark.read.parquet(f"{a.output}/pages")
    flat = works.typed(works.flatten(works.parse_works(read.where("json IS NOT NULL")).where("NOT rejected")))
    sinks.write_parquet(flat, f"{a.output}/works")
    saved = files.flat_works(spark, f"{a.output}/works")
    sinks.write_json(works.summary(saved), f"{a.output}/summary")
    works.summary_report(saved).coalesce(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(f"{a.output}/report")
    if cut := read.where("error IS NOT NULL").first():
        raise SystemExit(f"incomplete: {cut['error']}; go on with " + ("--resume" if "span" in read.columns else f"--cursor {cut['cursor']}"))


def chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunks papers (``<prefix>/<paper_id>/document.md`` with ``metadata.json``) that have no chunks yet."""
    from .operators.assembly import papers
    from .operators.operations import to_do

    found = papers(files.paper_texts(spark, a.input), files.paper_metadata(spark, a.input))
    done = spark.createDataFrame([], "paper_id string")
    if a.done:
        done = files.chunks(spark, a.done, "coarse").select("paper_id").distinct()
    todo = to_do(found, done, "paper_id", a.limit, a.force)
    sinks.write_chunks(chunking.hybrid_chunks(todo, both=not a.coarse_only), a.output)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Embeds chunks and writes the searchable table; ``--dry-run`` stops after the cost."""
    found = files.chunks(spark, a.input, a.chunk_type)
    evaluation.embedding_cost(found, a.price).show(truncate=False)
    if not a.dry_run:
        sinks.write_index(retrieval.index(found), a.output)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    """Shows the best chunks for a question."""
    if not a.question.strip():
        raise SystemExit("the question is empty")
    asked = retrieval.embed_queries(spark.createDataFrame([(0, a.question)], "query_id int, query string"))
    hits = retrieval.search(files.index(spark, a.index, a.chunk_type), asked, k=a.top_k if not a.rerank else 75, candidates=75)
    hits = retrieval.rerank(hits, a.top_k) if a.rerank else hits
    hits.select("rank", F.round("score", 4).alias("score"), "paper_id", "section_hierarchy", "text").orderBy("rank").show(a.top_k, truncate=80)


def _named(path: str):
    """``package.module:name``."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _get(url: str) -> tuple[str, bytes]:
    with urlopen(url, timeout=60) as f:
        return f.headers.get("Content-Type", ""), f.read()


def download(spark: SparkSession, a: argparse.Namespace) -> None:
    """Downloads the PDFs of works (Parquet of flat works) that aren't there yet, and writes files, outcomes and counters."""
    rebuilt = works.rebuilt(files.flat_works(spark, a.works))
    rows = rebuilt.select(F.col("work.id").alias("id"), works.best_pdf_url(F.col("work")).alias("url"))
    rows = rows.where("url IS NOT NULL") if a.only_with_pdfs else rows
    rows = rows.orderBy("id").limit(a.max) if a.max else rows
    done = files.pdf_store(spark, a.done).select("id") if a.done else spark.createDataFrame([], "id string")
    todo = operations.unprocessed(rows, done, "id").repartition(a.workers)
    sinks.write_parquet(sinks.fetched(todo, _named(a.fetch) if a.fetch else _get), f"{a.output}/pdfs")
    got = spark.read.parquet(f"{a.output}/pdfs").select("id", "status", "error")
    skipped = operations.processed(rows, done, "id").select("id", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    outcomes = got.unionByName(skipped)
    sinks.write_json(outcomes, f"{a.output}/outcomes")
    operations.run_counters(outcomes).show(truncate=False)
    operations.first_failures(outcomes).show(truncate=False)


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Parses PDFs to documents, Markdown, figures and failures; with ``--worker`` and ``--workers`` one worker's share of them."""
    from .operators import assembly

    listed = files.pdfs(spark, a.input).select("path", "doc_id")
    if a.workers > 1:  # shares of all files, whenever a worker starts
        listed = operations.modulo_shard(listed, "path", a.worker, a.workers)
    if a.done:
        finished = spark.read.parquet(a.done).select("paper_id").distinct()
        listed = operations.unprocessed(listed, finished.withColumnRenamed("paper_id", "doc_id"), "doc_id")
    content = files.bytes_of(spread(listed))
    renderer = _named(a.renderer) if a.renderer else parsing.installed_renderer
    parsed = parsing.parse_documents(content, renderer, _named(a.model))
    mode = "append" if a.workers > 1 else "overwrite"  # a worker only adds its own share
    documents = stored(parsed.documents, "parsed-documents")
    sinks.write_parquet(documents, f"{a.output}/documents", mode=mode)
    papers = assembly.markdown(documents).select(names.pdf_id("source_file").alias("paper_id"), "markdown")
    sinks.write_documents(papers, f"{a.output}/markdown", mode)
    sinks.write_figures(parsed.figures, f"{a.output}/figures", mode)
    sinks.write_parquet(parsed.failures, f"{a.output}/failures", mode=mode)
    n_failed = parsed.failures.select("source_file").distinct().count()
    print(f"{documents.count()} documents, {n_failed} with failures")


def status(spark: SparkSession, a: argparse.Namespace) -> None:
    """Shows how far a corpus is: counts, last upload, files by hour, rate and time left; and what to do if it stands still."""
    total = files.pdfs(spark, a.input).count()
    objects = files.objects(spark, a.output)
    done = files.folders(objects, a.prefix or f"{a.output.rstrip('/')}/").count()
    now = F.current_timestamp()
    by_hour = operations.hourly(objects, now)
    row = operations.status(total, done, by_hour, objects, now)
    row.show(truncate=False)
    operations.newest_hours(by_hour).show()
    if not row.first()["active"]:
        print("\n".join(operations.IDLE_ADVICE))


def info(spark: SparkSession, a: argparse.Namespace) -> None:
    """Shows versions, settings and what is installed."""
    conf = spark.conf
    rows = [("python", platform.python_version()), ("spark", spark.version), ("master", spark.sparkContext.master), ("adaptive", conf.get("spark.sql.adaptive.enabled")), ("shuffle partitions", conf.get("spark.sql.shuffle.partitions"))]
    rows += [(name, "installed" if importlib.util.find_spec(name) else "absent") for name in ("pypdfium2", "tokenizers", "sentencepiece", "onnxruntime")]
    spark.createDataFrame(rows, "name string, value string").show(len(rows), truncate=False)


def ask(spark: SparkSession, a: argparse.Namespace) -> None:
    """Answers a question from the searchable table with a chat model (``package.module:function``)."""
    question = spark.createDataFrame([(0, a.question, a.model)], "query_id int, query string, model string")
    retriever = answers.create_retriever(files.index(spark, a.index, a.chunk_type), reranker=None if a.no_rerank else retrieval.overlap_model)
    row = answers.answers(question, retriever, _named(a.chat), a.top_k).first()
    if row is None:
        raise SystemExit("the question is empty or the model unknown")
    print(row["answer"] if row["answer"] is not None else f"no answer: {row['error']}")
    for c in row["citations"]:
        print(f"[{c['id']}] {c['title']} ({c['paper_id']})")


def serve(spark: SparkSession, a: argparse.Namespace) -> None:
    """Serves search and answers over HTTP until it is stopped."""
    from .service import Service

    service = Service(spark, chat=_named(a.chat) if a.chat else None).load(files.index(spark, a.index, a.chunk_type), reranker=retrieval.overlap_model)
    with service.server(a.port, a.host) as server:
        print(f"serving on {a.host}:{server.server_port}")
        server.serve_forever()


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    """Writes the HTML report on saved metrics."""
    sinks.write_html(spark, reports.html_report(spark.read.json(a.input)), a.output)


def set_up_logging(level: str = "INFO", path: str | None = None) -> None:
    """Logs to the console, and to a file that is rotated at 10 MB."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.handlers.RotatingFileHandler(path, maxBytes=10 << 20, backupCount=5))
    logging.basicConfig(level=level, handlers=handlers, format="%(asctime)s %(levelname)s %(name)s %(message)s", force=True)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scores the chunking strategies on papers and writes metrics as JSON."""
    docs = files.paper_texts(spark, a.input).withColumn("paper_title", F.col("paper_id")).orderBy("paper_id")
    docs = docs.limit(a.papers) if a.papers else docs
    sinks.write_json(evaluation.strategy_score(evaluation.evaluate(chunking.strategies(docs))), a.output)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="scriptorium")
    parser.add_argument("--log-level", default="WARNING")
    parser.add_argument("--log-file")
    commands = parser.add_subparsers(required=True)

    def command(run, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        for name, settings in options:
            sub.add_argument(name, **settings)
        sub.set_defaults(run=run)

    out = ("--output", {"required": True})
    kind = ("--chunk-type", {"default": "coarse", "choices": ["coarse", "fine"]})
    command(fetch_works, ("--filter", {"default": ""}), ("--per-page", {"type": int, "default": 200}), ("--url", {}), ("--email", {}), ("--pages", {}), ("--cursor", {}),
            ("--field", {}), ("--first", {"type": int}), ("--last", {"type": int}), ("--most", {"type": int}), ("--resume", {"action": "store_true"}), out)
    command(
        download, ("works", {}), ("--max", {"type": int}), ("--workers", {"type": int, "default": 5}), ("--only-with-pdfs", {"action": argparse.BooleanOptionalAction, "default": True}),
        ("--done", {}), ("--fetch", {}), out,
    )
    command(parse, ("input", {}), ("--model", {"required": True}), ("--renderer", {}), ("--done", {}), ("--worker", {"type": int, "default": 0}), ("--workers", {"type": int, "default": 1}), out)
    command(status, ("input", {}), ("output", {}), ("--prefix", {}))
    command(info)
    command(report, ("input", {}), out)
    command(serve, ("index", {}), kind, ("--chat", {}), ("--port", {"type": int, "default": 8000}), ("--host", {"default": "127.0.0.1"}))
    command(ask, ("index", {}), ("question", {}), kind, ("--chat", {"required": True}), ("--model", {}), ("--top-k", {"type": int, "default": 10}), ("--no-rerank", {"action": "store_true"}))
    command(chunk, ("input", {}), ("--done", {}), ("--limit", {"type": int}), ("--force", {"action": "store_true"}), ("--coarse-only", {"action": "store_true"}), out)
    command(index, ("input", {}), kind, ("--price", {"type": float, "default": 0.02}), ("--dry-run", {"action": "store_true"}), out)
    command(search, ("index", {}), ("question", {}), kind, ("--top-k", {"type": int, "default": 10}), ("--rerank", {"action": "store_true"}))
    command(evaluate, ("input", {}), ("--papers", {"type": int}), out)
    args = parser.parse_args(argv)
    set_up_logging(args.log_level, args.log_file)
    args.run(session(), args)


if __name__ == "__main__":
    main()
