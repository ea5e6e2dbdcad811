"""The parser, answers, reports, model behaviour and commands, with stand-ins for what needs a network or a model."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium import errors
from scriptorium.functions import images, models, names
from scriptorium.operators import answers, assembly, evaluation, parsing, reports, retrieval

#: Layouts by the page's first sample: two elements and a figure, an element too small to crop, an error.
LAYOUTS = {
    1: "[100,100,500,200][sec_0][PAIR_SEP][100,300,800,500][para][PAIR_SEP][100,600,300,800][fig]",
    2: "[100,100,100,100][para][PAIR_SEP][50,200,850,400][tab]",
    4: "",
}


def renderer():
    """A document's bytes are (page, width, height) triples."""

    def render(data, longest):
        if data == b"broken":
            raise ValueError("bad file")
        for page, width, height in zip(data[::3], data[1::3], data[2::3], strict=True):
            image = np.full((height, width, 3), page, np.uint8)
            image[0, 0] = page
            yield image

    return render


def page_model():
    def call(pngs, prompts):
        out = []
        for png, prompt in zip(pngs, prompts, strict=True):
            sample = images.from_png(png)
            page = int(sample.max())
            if prompt == assembly.LAYOUT_PROMPT:
                if page == 3:
                    raise RuntimeError("no layout")
                out.append(LAYOUTS[page])
            else:
                out.append(f" {prompt.split()[1]} {prompt.split()[2]} of {page}: {sample.shape[1]}x{sample.shape[0]} ")
        return out

    return call


@pytest.fixture(scope="module")
def pdfs(spark):
    rows = [("in/a_1_x.pdf", bytes([1, 90, 120, 2, 100, 100])), ("in/b_2_y.pdf", bytes([3, 50, 50, 4, 60, 60])), ("in/c.pdf", b"broken"), ("in/d.pdf", b""), ("in/e.txt", b"x"), ("in/f.pdf", None)]
    return spark.createDataFrame(rows, "path string, content binary")


def test_parse_documents(spark, pdfs):
    parsed = parsing.parse_documents(pdfs, renderer, page_model, batch=1)
    docs = {r["source_file"]: r for r in parsed.documents.collect()}
    assert {k: r["total_pages"] for k, r in docs.items()} == {"in/a_1_x.pdf": 2, "in/b_2_y.pdf": 2}
    first, second = docs["in/a_1_x.pdf"]["pages"]
    assert [(e["label"], e["reading_order"]) for e in first["elements"]] == [("sec_0", 0), ("para", 1), ("fig", 2)]
    assert first["elements"][0]["text"] == "text in of 1: 55x15"  # 896 units are 120 pixels; both ends belong to the box
    assert first["elements"][2]["text"] == "![Figure](figures/figure_001_002.png)" == f"![Figure]({first['elements'][2]['figure_path']})"
    assert first["elements"][0]["bbox"] == [0, 13, 53, 28]  # in the page itself: 15 pixels of padding on the left are gone, and clamped
    assert [(e["label"], e["text"].split(" of ")[0]) for e in second["elements"]] == [("tab", "the table")]
    assert [len(p["elements"]) for p in docs["in/b_2_y.pdf"]["pages"]] == [0, 0]
    failures = sorted((r["source_file"], r["page_number"], r["reading_order"] if r["reading_order"] is not None else -1, r["error_class"]) for r in parsed.failures.collect())
    assert failures == [
        ("in/a_1_x.pdf", 2, 0, "RecognitionError"), ("in/b_2_y.pdf", 1, -1, "LayoutError"), ("in/c.pdf", 1, -1, "ImageExtractionError"),
        ("in/d.pdf", 1, -1, "ImageExtractionError"), ("in/e.txt", 1, -1, "ImageExtractionError"), ("in/f.pdf", 1, -1, "ImageExtractionError"),
    ]
    figure = parsed.figures.first()
    assert figure["figure_path"] == "figures/figure_001_002.png" and images.from_png(figure["crop"]).shape == (28, 28, 3)
    pages = assembly.markdown(parsed.documents).where("source_file LIKE '%a_1%'").first()["markdown"]
    assert pages.startswith("# text in of 1") and "---" in pages and "![Figure]" in pages


def test_nothing_to_parse(pdfs):
    parsed = parsing.parse_documents(pdfs.limit(0), renderer, page_model)
    assert parsed.documents.count() == parsed.figures.count() == parsed.failures.count() == 0


def test_stages(pdfs):
    stages = parsing.parsing_stages(renderer, page_model)
    said = []
    got = parsing.run_stages(pdfs.limit(1), stages, keep=True, log=said.append)
    assert said == ["images", "layout", "crops", "recognition", "documents"]
    assert [p["page_number"] for p in got.first()["pages"]] == [1, 2]
    with pytest.raises(errors.ValidationError, match="content"):
        stages[0].process(pdfs.drop("content"))
    assert len(stages[0].process_batch([pdfs, pdfs])) == 2


def test_images():
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    data = images.to_png(image)
    assert (images.from_png(data) == image).all() and data[:8] == images.SIGNATURE and zlib.crc32(b"IEND").to_bytes(4, "big") == data[-4:]
    square, dims = images.padded(image)
    assert square.shape == (7, 7, 3) and (square[1:6] == image).all() and not square[0].any() and not square[6].any()
    assert dims == {"original_width": 7, "original_height": 5, "padded_width": 7, "padded_height": 7}
    assert images.cropped(square, 0, 1, 7, 6).shape == (5, 7, 3)
    for box in ((0, 0, 3, 7), (0, 0, 7, 3), (9, 9, 20, 20)):
        with pytest.raises(ValueError):
            images.cropped(square, *box)
    with pytest.raises(ValueError):
        images.from_png(b"GIF89a")


def test_model_behaviour():
    waits, calls = [], []

    def failing(times):
        def call(texts):
            calls.append(len(texts))
            if len(calls) <= times:
                raise OSError("down")
            return np.ones((len(texts), 2), np.float32)

        return call

    assert models.retrying(failing(2), 3, 4, sleep=waits.append)(["a"]).shape == (1, 2) and waits == [4, 8]
    with pytest.raises(OSError):
        models.retrying(failing(99), 2, 4, sleep=waits.append)(["a"])

    def small(texts):
        if len(texts) > 2 or "bad" in texts:
            raise ValueError("too many")
        return np.array([[len(t)] for t in texts], np.float32)

    assert models.halving(small)(list("abcde") + ["xx"]).ravel().tolist() == [1, 1, 1, 1, 1, 2]
    with pytest.raises(ValueError):
        models.halving(small)(["a", "bad"])
    assert models.or_original(lambda q, t: 1 / 0)(["q"], ["t"]) == [None]

    loads = []
    handle = models.ModelHandle(lambda: loads.append(1) or (lambda images, prompts: [p.upper() for p in prompts]))
    assert not handle.is_loaded and handle.chat("a", b"") == "A" and handle.chat(["a", "b"], [b"", b""]) == ["A", "B"] and handle.is_loaded and len(loads) == 1
    handle.unload()
    assert not handle.is_loaded
    with pytest.raises(ValueError):
        handle([b""], [])
    with pytest.raises(errors.ModelLoadError):
        models.ModelHandle(lambda: 1 / 0).load()


def test_reranker_failure_keeps_order(spark):
    hits = spark.createDataFrame([(0, "q", i, f"t{i}", 1.0 - i / 10, i) for i in range(5)], "query_id int, query string, vec_id int, text string, score double, rank int")
    got = retrieval.rerank(hits, 3, lambda: models.or_original(lambda q, t: 1 / 0)).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(0, 1.0), (1, 0.9), (2, 0.8)]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(f"p{i % 3}_{i}", "coarse", f"p{i % 3}", f"Paper {i % 3}\nsub", f"carbon tax in town {i}" if i % 2 else f"trains and rails {i}", ["A"]) for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_type string, paper_id string, paper_title string, text string, section_hierarchy array<string>")
    return retrieval.index(chunks)


def chat_model():
    def call(model, prompt, temperature):
        if "sonnet" in model or "fail" in prompt:
            raise RuntimeError("unavailable")
        return f"{model}|{temperature}|{prompt.count('### Source')}"

    return call


def test_answers(spark, vectors):
    retriever = answers.create_retriever(vectors, reranker=retrieval.overlap_model)
    default, other, down = retrieval.DEFAULT_MODEL, "openrouter/deepseek/deepseek-r1", "openrouter/anthropic/claude-3.5-sonnet"
    asked = [(1, "carbon tax", None), (2, "carbon tax", other), (3, "trains", down), (4, " ", None), (5, "x", "unknown"), (6, "fail", down)]
    got = {r["query_id"]: r for r in answers.answers(spark.createDataFrame(asked, "query_id int, query string, model string"), retriever, chat_model, k=4).collect()}
    assert set(got) == {1, 2, 3, 6}
    assert got[1]["answer"] == f"{default}|1.0|4" and got[2]["answer"] == f"{other}|0.3|4" and got[2]["sources_used"] == 4
    assert got[3]["answer"] == f"[Using fallback model {default}]\n\n{default}|1.0|4" and got[3]["answered_by"] == default and down in got[3]["error"]
    assert got[6]["answer"] is None and got[6]["error"].count("RuntimeError") == 2
    assert [c["id"] for c in got[1]["citations"]] == list(range(1, len(got[1]["citations"]) + 1)) and len({c["paper_id"] for c in got[1]["citations"]}) == len(got[1]["citations"])
    none = answers.answers(spark.createDataFrame(asked[:1], "query_id int, query string, model string"), answers.create_retriever(vectors.limit(0)), chat_model).first()
    assert none["answer"] == answers.NO_SOURCES and none["sources_used"] == 0 and none["citations"] == []
    assert retriever.health() == {"status": "ok", "index_loaded": True, "index_size": 12, "chunk_type": "coarse"}
    with pytest.raises(ValueError):
        answers.create_retriever(vectors, None)


def test_reports(spark):
    schema = "strategy string, count long, mean_chars double, std_chars double, coherence double, boundary double, citation_coverage double"
    m = spark.createDataFrame([("a", 10, 2000.0, 300.0, 0.5, 0.2, 0.5), ("b", 20, 900.0, 1500.0, 0.7, None, 0.1)], schema)
    assert reports.total_chunks(m).first()[0] == 30 and reports.total_chunks(m.limit(0)).first()[0] == 0
    bars = {(r["strategy"], r["panel"]): r["value"] for r in reports.dashboard(m).collect()}
    assert len(bars) == 8 and bars["b", "Boundary similarity"] == 0.0 and bars["a", "Coherence"] == 0.5
    axes = {(r["strategy"], r["axis"]): r["value"] for r in reports.radar(m).collect()}
    assert axes["a", "coherence"] == 0 and axes["b", "coherence"] == 1 and axes["a", "std_chars"] == 1 and axes["b", "boundary"] == 0
    why = {r["strategy"]: r["reasons"] for r in reports.reasons(m).collect()}
    assert why["a"] == ["Semantic coherence 0.500", "Boundary similarity 0.200", "Citations in 50.0% of the chunks", "Chunk sizes with a deviation of 300 characters"] and len(why["b"]) == 3
    assert [i["description"].split()[0] for i in reports.insights(m)] == ["b", "a", "a", "a"]
    assert "30 chunks" in reports.executive_summary(m) and reports.recommendation(m).startswith("Recommended: a,") and reports.recommendation(m.limit(0)) is None
    assert reports.html_report(m.limit(0)).count("<svg") == 0


def test_samples_and_small_ones(spark):
    chunks = spark.range(100).select(F.concat(F.lit("c"), "id").alias("chunk_id"))
    first = sorted(r[0] for r in evaluation.sample_chunks(chunks, 20, 1).collect())
    assert len(set(first)) == 20 and first == sorted(r[0] for r in evaluation.sample_chunks(chunks.repartition(7), 20, 1).collect())
    assert first != sorted(r[0] for r in evaluation.sample_chunks(chunks, 20, 2).collect())
    assert evaluation.overlap_efficiency(chunks).first()[0] == 0.0
    wanted = {"fr-CH, en;q=0.9": "fr", "de, en;q=0.5, fr;q=0.7": "fr", "": "en", None: "en", "de": "en", "en;q=0, fr;q=0.1": "fr", "*": "en", "FR;q=x": "fr"}
    df = spark.createDataFrame([(h,) for h in wanted], "h string")
    assert {r["h"]: r["l"] for r in df.select("h", names.negotiated_language("h").alias("l")).collect()} == wanted
    kept = spark.range(1).select(names.known_values(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(None))).alias("m")).first()["m"]
    assert kept == {"a": 1}
    assert names and spark.range(1).select(names.is_pdf(F.lit("application/PDF"), F.lit(None).cast("string"))).first()[0]


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from scriptorium import cli
    from scriptorium.sources import files

    (tmp_path / "in").mkdir()
    for name, data in (("a_1_x.pdf", bytes([1, 90, 120])), ("b_2_y.pdf", bytes([4, 60, 60])), ("c_3_z.pdf", b"broken")):
        (tmp_path / "in" / name).write_bytes(data)
    parse = ["parse", str(tmp_path / "in"), "--model", "tests.test_parsing:page_model", "--renderer", "tests.test_parsing:renderer"]
    cli.main([*parse, "--output", str(tmp_path / "parsed")])
    assert "2 documents, 1 with failures" in capsys.readouterr().out
    assert {r["paper_id"] for r in spark.read.parquet(str(tmp_path / "parsed" / "markdown")).collect()} == {"a_1", "b_2"}
    for worker in ("0", "1"):
        cli.main([*parse, "--worker", worker, "--workers", "2", "--output", str(tmp_path / "shared")])
    assert spark.read.parquet(str(tmp_path / "shared" / "documents")).count() == 2
    cli.main([*parse, "--done", str(tmp_path / "parsed" / "markdown"), "--output", str(tmp_path / "rest")])
    assert spark.read.parquet(str(tmp_path / "rest" / "documents")).count() == 0
    cli.main(["status", str(tmp_path / "in"), str(tmp_path / "parsed")])
    cli.main(["info"])
    out = capsys.readouterr().out
    assert "processed" in out and spark.version in out

    works = [json.dumps({"id": f"https://w/W{i}", "open_access": {"is_oa": True}, "best_oa_location": {"pdf_url": f"http://x/{i}.pdf"} if i else None}) for i in range(4)]
    from scriptorium.operators import works as w

    flat = w.flatten(w.parse_works(spark.createDataFrame([(x,) for x in works], "json string")))
    flat.write.parquet(str(tmp_path / "works"))
    monkeypatch.setattr(cli, "_get", fake_get)
    cli.main(["download", str(tmp_path / "works"), "--fetch", "tests.test_parsing:fake_get", "--output", str(tmp_path / "got")])
    assert {r["id"] for r in files.pdf_store(spark, str(tmp_path / "got")).collect()} == {"https://w/W1", "https://w/W3"}
    cli.main(["download", str(tmp_path / "works"), "--fetch", "tests.test_parsing:fake_get", "--done", str(tmp_path / "got"), "--no-only-with-pdfs", "--output", str(tmp_path / "again")])
    outcomes = {r["id"][-1]: r["status"] for r in spark.read.json(str(tmp_path / "again" / "outcomes")).collect()}
    assert outcomes == {"0": "no_url", "1": "skipped", "2": "failed", "3": "skipped"}


def fake_get(url):
    if url.endswith("2.pdf"):
        raise OSError("down")
    return "application/pdf", b"%PDF"


def test_ask(spark, vectors, tmp_path, capsys):
    from scriptorium import cli
    from scriptorium.sources import sinks

    sinks.write_index(vectors, str(tmp_path / "index"))
    cli.main(["ask", str(tmp_path / "index"), "carbon tax", "--chat", "tests.test_parsing:chat_model", "--top-k", "3"])
    assert f"{retrieval.DEFAULT_MODEL}|1.0|3" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["ask", str(tmp_path / "index"), " ", "--chat", "tests.test_parsing:chat_model"])


def test_service(spark, vectors):
    import threading

    from scriptorium.service import Service, search_documents

    service = Service(spark)
    assert service.handle("GET", "/health", {})[1]["index_loaded"] is False and service.handle("POST", "/search", {"query": "x"})[0] == 503
    service.load(vectors, reranker=retrieval.overlap_model)
    assert service.handle("GET", "/", {})[0] == 200 and service.handle("GET", "/nothing", {})[0] == 404
    assert service.handle("GET", "/health", {})[1]["index_size"] == 12 and len(service.handle("GET", "/models", {})[1]["models"]) == len(retrieval.MODELS)
    assert service.handle("POST", "/search", {"query": " "})[0] == 400 and service.handle("POST", "/chat", {"message": "x"})[0] == 503
    service.chat = chat_model
    status, found = service.handle("POST", "/chat", {"message": "carbon tax", "top_k": 2})
    assert status == 200 and found["answer"].endswith("|2") and found["sources_used"] == 2 and found["citations"]
    assert service.handle("POST", "/chat", {"message": "x", "model": "unknown"})[0] == 400 and service.handle("POST", "/chat", {"message": "fail"})[0] == 503
    with service.server(0) as server:
        thread = threading.Thread(target=server.serve_forever, daemon=True)
        thread.start()
        got = search_documents(f"http://127.0.0.1:{server.server_port}", "carbon tax", 3)
        server.shutdown()
    assert got["total_results"] == 3 and [r["rank"] for r in got["results"]] == [0, 1, 2] and got["results"][0]["text"].startswith("carbon tax")
    service.close()
    assert service.retriever is None


def test_other_commands_and_sinks(spark, tmp_path, capsys):
    """fetch-works, evaluate, report; outcomes of addresses, failures by worker, samples."""
    from scriptorium import cli
    from scriptorium.sources import files, sinks

    pages = tmp_path / "pages"
    pages.mkdir()
    work = lambda i: {"id": f"https://w/W{i}", "open_access": {"is_oa": True, "oa_status": "gold"}, "cited_by_count": i}
    (pages / "start.json").write_text(json.dumps({"results": [work(1), work(2)], "meta": {"next_cursor": "c2"}}))
    fetch = ["fetch-works", "--pages", str(pages), "--output", str(tmp_path / "works")]
    with pytest.raises(SystemExit, match="--cursor c2"):
        cli.main(fetch)
    assert files.flat_works(spark, str(tmp_path / "works" / "works")).count() == 2
    (pages / "c2.json").write_text(json.dumps({"results": [work(3)], "meta": {}}))
    cli.main(fetch)
    assert spark.read.json(str(tmp_path / "works" / "summary")).first()["total_citations"] == 6
    assert "Works: 3" in {r["value"] for r in spark.read.text(str(tmp_path / "works" / "report")).collect()}

    for i in range(3):
        (tmp_path / "papers" / f"p{i}").mkdir(parents=True)
        (tmp_path / "papers" / f"p{i}" / "document.md").write_text("# A\n\n" + f"Some sentence about rivers and towns {i}. Another sentence about hills. " * 30 + "\n\n" + "More on the same. " * 200)
    cli.main(["evaluate", str(tmp_path / "papers"), "--output", str(tmp_path / "metrics")])
    assert {r["strategy"] for r in files.report(spark, str(tmp_path / "metrics")).collect()} <= {"hybrid", "fixed", "semantic"}
    cli.main(["report", str(tmp_path / "metrics"), "--output", str(tmp_path / "html")])
    assert "Recommended:" in spark.read.text(str(tmp_path / "html"), wholetext=True).first()["value"]

    urls = spark.sql("SELECT named_struct('id', concat('W', id)) AS work, CASE WHEN id > 0 THEN concat('http://x/', id, '.pdf') END AS url FROM range(4)")
    existing = spark.createDataFrame([("W1",)], "id string")
    got = {r["id"]: r["status"] for r in sinks.url_outcomes(urls, F.col("url"), existing, fake_get).collect()}
    assert got == {"W0": "no_url", "W1": "skipped", "W2": "failed", "W3": "ok"}
    rows = spark.createDataFrame([("w1", "d1", "ValueError"), ("w2", "d2", "OSError")], "worker_id string, doc_id string, error string")
    sinks.write_failures(rows, str(tmp_path / "failures"))
    assert spark.read.json(str(tmp_path / "failures" / "worker_id=w1")).first()["doc_id"] == "d1"
    papers = spark.createDataFrame([(f"p{i}", "x") for i in (3, 1, 2)], "paper_id string, markdown string")
    assert [r["paper_id"] for r in sinks.sample_papers(papers, 2).collect()] == ["p1", "p2"]


def test_bucketed_sinks(spark, tmp_path):
    from scriptorium.sources import sinks

    docs = spark.range(300).select(F.concat(F.lit("p"), "id").alias("paper_id"), F.lit("# x").alias("markdown"))
    sinks.write_documents(docs, str(tmp_path / "docs"), buckets=4)
    assert len([p for p in (tmp_path / "docs").iterdir() if p.is_dir()]) == 4
    assert spark.read.parquet(str(tmp_path / "docs")).select("paper_id", "markdown").exceptAll(docs).count() == 0
    sinks.export_documents(docs.limit(3), str(tmp_path / "few"))
    assert len([p for p in (tmp_path / "few").iterdir() if p.is_dir()]) == 3
    works = spark.sql("SELECT named_struct('id', concat('https://w/W', id)) AS work FROM range(5)")
    sinks.write_works(works, str(tmp_path / "works"), buckets=2)
    assert {r["key"] for r in spark.read.parquet(str(tmp_path / "works")).collect()} == {f"W{i}" for i in range(5)}
