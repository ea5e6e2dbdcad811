"""Scalars, sources and sinks, retrieval, evaluation, streaming: edge cases and round trips."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import layout, markdown, names, vectors
from scriptorium.functions.models import HashedWords, count_tokens, overlap_reranker
from scriptorium.operators import assembly, chunking, evaluation, operations, reports, retrieval, works
from scriptorium.plans import fixtures
from scriptorium.sources import files, sinks, works_api
from scriptorium.streaming import incremental


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("", "untitled"), ("a<b>:c", "a_b_c"), ("__x  y__", "x_y"), ("é ü", "é_ü")])
def test_sanitize(spark, raw, want):
    assert value(spark, names.sanitize_filename(F.lit(raw))) == want


def test_small_scalars(spark):
    assert value(spark, names.pdf_id(F.lit("a/b.pdf_c.pdf"))) == "b_c"
    assert value(spark, names.stem_id(F.lit("a/b.pdf_c.pdf"))) == "b.pdf_c"
    assert value(spark, names.format_bytes(F.lit(1024**6))) == "1024.00 PB"
    assert value(spark, names.normalize_doi(F.lit(" doi: https://doi.org/10.1/A?x#y "))) == "10.1/A"
    assert value(spark, names.filter_map(F.lit("a:1, b : u:2 ,skip,a:3"))) == {"a": "3", "b": "u:2"}
    assert value(spark, names.normalize_score(F.lit(5.0), F.lit(2.0), F.lit(2.0))) == 0.5
    assert value(spark, count_tokens(F.lit("x" * 11))) == 2
    assert value(spark, retrieval.temperature(F.lit("a/gpt-5-mini"))) == 1.0


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, vectors.norm(a)) == 5.0
    assert value(spark, vectors.normalized(zero)) == [0.0, 0.0]
    assert value(spark, vectors.cosine(a, zero)) is None


def test_mean_cosine_of_groups(spark):
    """Against all pairs: a group in several tasks, one vector alone, zero vectors, a null group and null vectors."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(["a", "b", None][i % 3], rng.normal(size=5).tolist()) for i in range(90)] + [("one", [1.0] * 5), ("a", [0.0] * 5), ("b", None)]
    got = {r["g"]: (r["vectors"], r["coherence"]) for r in vectors.mean_cosine(spark.createDataFrame(rows, "g string, embedding array<double>").repartition(4), "g").collect()}
    for group in ("a", "b", None):
        v = np.array([x for g, x in rows if g == group and x])
        n = np.linalg.norm(v, axis=1)
        u = v / np.where(n > 0, n, 1)[:, None]
        assert got[group] == (len(v), pytest.approx(((u @ u.T).sum() - (u * u).sum()) / (len(v) * (len(v) - 1))))
    assert got["one"] == (1, None) and len(got) == 4


def test_many_citations(spark):
    """1,000 patterns a document, overlapping and repeated ones, nulls; equal to searching each in each piece."""
    from scriptorium.operators import chunking

    patterns = [f"[{i}]" for i in range(996)] + ["[1", "]", "[1]", "\U0001f600"]
    texts = [" ".join(f"w{i} [{i * 7 % 2000}]" for i in range(300)) + " \U0001f600", "nothing", "", None]
    docs = spark.createDataFrame([(i, t, patterns if i != 1 else None) for i, t in enumerate(texts)], "doc_id int, text string, cites array<string>")
    options = chunking.SplitOptions(size=200, overlap=20, least=1)
    got = chunking.plain_chunks(docs, "fixed", options, keep=["doc_id"], citations_col="cites").collect()
    assert len(got) > 10
    for r in got:
        own = patterns if r["doc_id"] != 1 else []
        assert r["citations"] == [p for p in own if p in r["text"]]


def test_split_harvest(spark, tmp_path):
    """Four ranges by counts, one of which fails on its second page: the others are complete, and it is taken up again."""
    counts = {"2000-2007": 90, "2000-2003": 60, "2004-2007": 30, "2000-2001": 30, "2002-2003": 30, "2004-2005": 0, "2006-2007": 30}
    for span, n in counts.items():
        (tmp_path / span).mkdir()
        (tmp_path / span / "count.json").write_text(json.dumps({"meta": {"count": n}}))

    def page(span, name, ids, following=None):
        (tmp_path / span / f"{name}.json").write_text(json.dumps({"results": [{"id": f"{span}/{i}"} for i in ids], "meta": {"next_cursor": following}}))

    assert works_api.planned(lambda a, b: counts[f"{a}-{b}"], 2000, 2007, 30) == [(2000, 2001), (2002, 2003), (2004, 2007)]
    for span in ("2000-2001", "2002-2003", "2004-2007"):
        page(span, "start", range(3), "next")
    page("2000-2001", "next", [3])
    page("2004-2007", "next", [3])
    spark.dataSource.register(works_api.RangesSource)
    options = {"pages": str(tmp_path), "first": "2000", "last": "2007", "most": "30", "wait": "0"}
    read = spark.read.format("works_ranges").options(**options).load()
    assert read.rdd.getNumPartitions() == 3
    read.write.parquet(str(tmp_path / "out"))
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.where("json IS NOT NULL").count() == 11
    assert json.loads(works_api.unfinished(kept)) == {"2002-2003": "next"}
    page("2002-2003", "next", [3, 4])
    rest = spark.read.format("works_ranges").options(**options, resume=works_api.unfinished(kept)).load()
    assert sorted(json.loads(r["json"])["id"] for r in rest.collect()) == ["2002-2003/3", "2002-2003/4"]
    assert works_api.unfinished(rest) is None
    (tmp_path / "2000-2001" / "start.json").unlink()  # a first page that fails
    again = spark.read.format("works_ranges").options(**options).load()
    assert json.loads(works_api.unfinished(again)) == {"2000-2001": "*"} and again.where("json IS NOT NULL").count() == 9


def test_top_k_ties_and_small_tables(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(7)] + [(9, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, None)], "query_id int, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.top_k(v, q, 50).collect()}
    assert [got[0, i] for i in range(7)] == [1, 3, 5, 0, 2, 4, 6] and [got[1, i] for i in range(7)] == list(range(7)) and len(got) == 14
    assert retrieval.top_k(v.limit(0), q, 3).count() == 0 and retrieval.top_k(v, q.limit(0), 3).count() == 0


def test_context_and_parents(spark):
    d = spark.createDataFrame([("p", "t", "# A\n\n" + "\n\n".join(f"{i} " + "w " * 60 for i in range(12)))], "paper_id string, paper_title string, markdown string")
    o = chunking.HybridOptions(coarse_max=300, fine_max=100)
    coarse, fine = chunking.coarse_chunks(d, o), chunking.fine_chunks(d, o)
    hits = coarse.where("chunk_index = 1").select(F.lit(0).alias("query_id"), F.lit(0).alias("rank"), F.lit(1.0).alias("score"), "*")
    assert len(retrieval.with_context(hits, coarse, 1).first()["context"]) == 3
    assert retrieval.fine_of_coarse(hits, fine).select("parent_chunk_id").distinct().count() == 1


def test_requests(spark):
    r = spark.createDataFrame([("a", None), (" ", None), ("b", "nope")], "query string, model string")
    assert [x["query"] for x in retrieval.valid_requests(r, retrieval.models(spark)).collect()] == ["a"]


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert set(evaluation.chunk_statistics(none).first().asDict().values()) == {0}
    assert set(evaluation.citation_integrity(none).first().asDict().values()) == {0}
    assert evaluation.embedding_cost(spark.createDataFrame([], "chunk_id string, text string"), 1.0).first()["tokens"] == 0


def test_coherence_against_pairs(spark):
    text = "The first sentence is about cats. The second sentence is about dogs! A third one has nothing in common? End"
    got = evaluation.coherence(spark.createDataFrame([(text,), ("short",)], "text string")).collect()
    e = HashedWords()(["The first sentence is about cats", "The second sentence is about dogs", "A third one has nothing in common"]).astype(float)
    c = e @ e.T
    assert got[0]["coherence"] == pytest.approx((c.sum() - np.trace(c)) / 6) and got[1]["coherence"] == 1.0


@pytest.mark.parametrize("with_citations, total, share", [(263, 514, 51.167), (278, 623, 44.623), (134, 226, 59.292)])
def test_published_coverage_ratios(spark, with_citations, total, share):
    chunks = spark.range(total).select(F.when(F.col("id") < with_citations, "as found [1] before").otherwise("no source").alias("text"))
    found = evaluation.citation_integrity(chunks).first()
    assert (found["chunks_with_citations"], found["total_chunks"]) == (with_citations, total) and round(100 * found["citation_coverage"], 3) == share


def test_layout_pushes_boxes_down(spark):
    dims = F.struct(*[F.lit(896).alias(n) for n in ("original_width", "original_height", "padded_width", "padded_height")])
    boxes = value(spark, layout.page_boxes(layout.parse_layout(F.lit("[100,100,300,300][a][PAIR_SEP][200,200,400,400][b]")), dims))
    assert [tuple(b["box"]) for b in boxes] == [(100, 100, 301, 301), (200, 301, 401, 401)]


def test_figure_placeholder_stays_text(spark):
    assert value(spark, markdown.figure(F.lit("[Figure 3]"), F.lit(0))) == "[Figure 3]\n\n"
    assert value(spark, markdown.unwrap_lines(F.lit("a-\nb\nc\n\n中\n文"))) == "ab c\n\n中文"


def test_titles(spark):
    schema = "source_file string, pages array<struct<page_number:int,elements:array<struct<label:string,text:string>>>>"
    rows = [("a/b.c.pdf", [(0, [("text", "x")])]), ("f.pdf", [(0, [("sec_0a", " T ")])]), ("f.pdf", [(0, [("title", None)])]), (None, [])]
    got = spark.createDataFrame(rows, schema).select(assembly.title(F.struct("source_file", "pages")).alias("t")).collect()
    assert [r["t"] for r in got] == ["b.c", "T", "Unknown Title", "Unknown Title"]


def test_documents_and_back(spark):
    rows = [("s", 1, [0, 0, 1, 1], "text", 0, "b", None), ("s", 0, [0, 0, 1, 1], "sec_0", 1, "T", None), ("s", 0, [0, 0, 1, 1], "text", 0, "a", None)]
    e = spark.createDataFrame(rows, "source_file string, page_number int, bbox array<int>, label string, reading_order int, text string, figure_path string")
    docs = assembly.documents(e)
    assert assembly.markdown(docs).first()["markdown"] == "a\n\n# T\n\n---\n\nb\n\n"
    assert assembly.all_elements(docs).count() == 3
    assert assembly.figure_link(e.withColumn("label", F.lit("fig"))).select("figure_path").distinct().count() == 3


def test_page_model_reports_errors(spark):
    pages = spark.createDataFrame([(1, b"x", "equ"), (2, b"", "tab")], "page int, image binary, label string")

    def model():
        def call(images, prompts):
            if not images[0]:
                raise ValueError("empty image")
            return [p[:4] for p in prompts]

        return call

    got = assembly.page_model(pages, model, "image", assembly.element_prompt("label"), "text", batch=1)
    assert {(r["page"], r["text"]) for r in got.collect()} == {(1, "Read"), (2, None)}
    assert assembly.failures(got, "page").first()["error"] == "ValueError: empty image"


def test_works_reject_and_round_trip(spark, data):
    good, bad = {"id": "https://w/W1", "open_access": {"is_oa": None, "oa_status": "gold"}, "extra": 1}, {"id": "W2", "open_access": {"oa_status": "new"}}
    parsed = works.parse_works(spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),), ("{",)], "json string"))
    assert [r["rejected"] for r in parsed.collect()] == [False, True, True]
    flat = works.flatten(parsed.where("NOT rejected")).first()
    assert flat["openalex_id"] == "W1" and flat["is_oa"] is False and flat["num_locations"] == 0 and not flat["has_any_pdf"]
    w = fixtures.works(spark, data)
    assert works.flatten(works.rebuilt(works.flatten(w)), full_json=False).exceptAll(works.flatten(w, full_json=False)).count() == 0
    assert works.summary_report(works.flatten(w, full_json=False).limit(0)).count() == 12
    flat = works.flatten(w, full_json=False)
    lines = [r["line"] for r in works.summary_report(flat).orderBy("place").collect()]
    n = flat.count()
    with_pdf = flat.where("has_any_pdf").count()
    assert lines[0] == f"Works: {n:,}" and lines[1] == f"Works with PDF URLs: {with_pdf:,} ({100 * with_pdf / n:.1f}%)" and lines[-1].startswith("Source, ")
    assert works.filtered(flat, lambda f: f["has_any_pdf"]).count() == with_pdf


def test_abstract(spark):
    w = spark.sql("SELECT named_struct('id', 'W', 'abstract_inverted_index', map('b', array(1), 'a', array(0, 2))) AS work")
    assert works.abstracts(w).first()["abstract"] == "a b a"


def test_works_source_walks_cursors_and_keeps_what_it_read(spark, tmp_path):
    spark.dataSource.register(works_api.WorksSource)
    with pytest.raises(Exception, match="start.json"):  # without the first page there is nothing
        spark.read.format("works_pages").options(pages=str(tmp_path), wait="0").load().collect()
    (tmp_path / "start.json").write_text(json.dumps({"results": [{"id": "1"}], "meta": {"next_cursor": "c2"}}))
    (tmp_path / "c2.json").write_text(json.dumps({"results": [{"id": "2"}], "meta": {"next_cursor": "gone"}}))
    got = spark.read.format("works_pages").options(pages=str(tmp_path), wait="0").load().collect()
    assert sorted(json.loads(r["json"])["id"] for r in got if r["json"]) == ["1", "2"]
    assert [(r["cursor"], "FileNotFoundError" in r["error"]) for r in got if r["error"]] == [("gone", True)]
    (tmp_path / "gone.json").write_text(json.dumps({"results": [{"id": "3"}], "meta": {}}))
    rest = spark.read.format("works_pages").options(pages=str(tmp_path), cursor="gone").load().collect()
    assert [json.loads(r["json"])["id"] for r in rest] == ["3"] and rest[0]["error"] is None
    assert works_api.request_parameters({"filter": "a:b", "email": "x@y"}, "*") == {"filter": "a:b", "per-page": "200", "cursor": "*", "mailto": "x@y"}


def test_chunk_store_round_trip(spark, data, tmp_path):
    found = chunking.hybrid_chunks(fixtures.markdown(spark, data).where("paper_id < 15"), chunking.HybridOptions(coarse_max=600, fine_max=150))
    sinks.write_chunks(found, str(tmp_path / "chunks"))
    back = files.chunks(spark, str(tmp_path / "chunks"), "fine")
    assert back.exceptAll(found.where("chunk_type = 'fine'").select(*back.columns)).count() == 0
    sinks.write_index(retrieval.index(found), str(tmp_path / "index"))
    assert files.index(spark, str(tmp_path / "index"), "coarse").count() == found.where("chunk_type = 'coarse'").count()


def test_files(spark, tmp_path):
    for paper, text, meta in (("p1", "# A", '{"source_file": "x.pdf"}'), ("p2", "b", "{broken"), ("p3", "c", None)):
        (tmp_path / paper).mkdir()
        (tmp_path / paper / "document.md").write_text(text)
        if meta:
            (tmp_path / paper / "metadata.json").write_text(meta)
    joined = assembly.papers(files.paper_texts(spark, str(tmp_path)), files.paper_metadata(spark, str(tmp_path)))
    assert {(r["paper_id"], r["paper_title"]) for r in joined.collect()} == {("p1", "x"), ("p2", "Unknown Title")}
    (tmp_path / "a_b_c.pdf").write_bytes(b"%PDF")
    (tmp_path / "n.md").write_text("text")
    assert [r["doc_id"] for r in files.pdfs(spark, str(tmp_path)).collect()] == ["a_b"]
    assert files.markdown_folder(spark, str(tmp_path)).first()["document_id"] == "n"
    assert {r["folder"] for r in files.folders(files.objects(spark, str(tmp_path)), f"{tmp_path}/").collect()} == {"p1", "p2", "p3"}


def test_fetched(spark):
    urls = spark.createDataFrame([("1", "http://x/a.pdf"), ("2", None), ("3", "http://x/b"), ("4", "http://x/c.pdf")], "id string, url string")

    def fetch(url):
        if url.endswith("c.pdf"):
            raise OSError("down")
        return "text/html", b"data"

    assert {(r["id"], r["status"]) for r in sinks.fetched(urls, fetch).collect()} == {("1", "ok"), ("2", "no_url"), ("3", "failed"), ("4", "failed")}


def test_places_and_status(spark):
    ids = spark.range(1000).where("id % 7 <> 3").select((F.col("id") * F.col("id")).alias("id"))
    got = [r["place"] for r in operations.global_places(ids, "id").orderBy("id").collect()]
    assert got == list(range(len(got)))
    assert operations.global_places(ids.limit(0), "id").count() == 0
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    objects = spark.sql("SELECT timestamp'2024-01-01 23:10:00' AS modificationTime, 'k' AS path")
    row = operations.status(0, 0, operations.hourly(objects, now), objects, now).first()
    assert row["percent"] is None and row["age"] == "50 minutes" and row["active"]


def test_reranker():
    assert overlap_reranker(["a b", ""], ["B c", "x"]) == [0.5, 0.0]


def test_streams(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("CAST(doc_id AS STRING) AS paper_id", "source AS paper_title", "text AS markdown")
    docs.limit(40).repartition(2).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = incremental.stream_table(spark, str(tmp_path / "in"), docs.schema, 1)
        incremental.chunk_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == chunking.hybrid_chunks(docs.limit(40)).count()
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert incremental.windowed_counts(events).agg(F.sum("events")).first()[0] == events.count()
    assert incremental.sessions(events).agg(F.sum("events")).first()[0] == events.count()


def test_report(spark):
    m = spark.createDataFrame([("a<", 2000.0, 300.0, 0.0, None, 0.5)], "strategy string, mean_chars double, std_chars double, coherence double, boundary double, citation_coverage double")
    page = reports.html_report(m.withColumn("count", F.lit(7)))
    assert "a&lt;" in page and "N/A" in page and "0.000" in page and "Recommended: a&lt;" in page and "<svg" in page


def test_command_line(spark, data, tmp_path, capsys):
    from scriptorium import cli

    for r in fixtures.markdown(spark, data).where("paper_id < 12").collect():
        folder = tmp_path / "in" / r["paper_id"]
        folder.mkdir(parents=True)
        (folder / "document.md").write_text(r["markdown"])
        (folder / "metadata.json").write_text(json.dumps({"source_file": f"{r['paper_id']}.pdf"}))
    cli.main(["chunk", str(tmp_path / "in"), "--output", str(tmp_path / "chunks")])
    cli.main(["chunk", str(tmp_path / "in"), "--done", str(tmp_path / "chunks"), "--limit", "3", "--output", str(tmp_path / "more")])
    cli.main(["index", str(tmp_path / "chunks"), "--output", str(tmp_path / "index")])
    cli.main(["search", str(tmp_path / "index"), "the and attion", "--rerank", "--top-k", "3"])
    assert "section_hierarchy" in capsys.readouterr().out
