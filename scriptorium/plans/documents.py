"""Queries over parsed elements, boxes, requests, reports, events and hits with context."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import layout, names
from ..operators import assembly, chunking, evaluation, operations, reports, retrieval, works
from ..sources.files import find_object, table
from ..scratch import scratch_path
from ..streaming import incremental, objects
from . import chunks, fixtures, records

# Elements of parsed documents: an order is an element of a page of one of 37 documents.
ELEMENTS = """concat('in/W', o_orderkey % 37, '_a.pdf') AS source_file, CAST(1 + (o_orderkey DIV 37) % 4 AS INT) AS page_number,
    array(CAST(o_custkey % 50 AS INT), 0, CAST(o_custkey % 50 + 10 AS INT), 5) AS bbox, element_at(array('text', 'sec_0', 'fig', 'list'), CAST(1 + o_orderkey % 4 AS INT)) AS label,
    CAST(o_orderkey AS INT) AS reading_order, concat('Element ', o_orderkey) AS text, CAST(NULL AS STRING) AS figure_path"""
ELEMENTS_SQL = """e AS (SELECT 'in/W' || (o_orderkey % 37) || '_a.pdf' AS source_file, CAST(1 + (o_orderkey // 37) % 4 AS INT) AS page_number, ['text', 'sec_0', 'fig', 'list'][1 + o_orderkey % 4] AS label,
    CAST(o_orderkey AS INT) AS reading_order, 'Element ' || o_orderkey AS text, CAST(o_custkey % 50 AS INT) AS x1 FROM orders)"""


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*[c.strip() for c in _columns(ELEMENTS)])


def _columns(text: str) -> list[str]:
    """Expressions of a select list, cut at commas outside of brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def document_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Elements to nested documents and back: pages and elements in order, numbered."""
    docs = assembly.documents(assembly.figure_link(_elements(spark, sf)))
    placed = docs.select("source_file", "total_pages", F.posexplode("pages").alias("page", "p")).select("source_file", "total_pages", "page", F.col("p.page_number").alias("page_number"), F.posexplode("p.elements").alias("place", "e"))
    return placed.select("source_file", "total_pages", "page", "page_number", "place", "e.label", "e.reading_order", "e.text", "e.figure_path")


DOCUMENT_ELEMENTS_SQL = f"""WITH {ELEMENTS_SQL}, n AS (SELECT *, printf('figures/figure_%03d_%03d.png', page_number, reading_order) AS name FROM e)
SELECT source_file, CAST((SELECT count(DISTINCT page_number) FROM e x WHERE x.source_file = n.source_file) AS INT) AS total_pages, CAST(dense_rank() OVER (PARTITION BY source_file ORDER BY page_number) - 1 AS INT) AS page, page_number,
    CAST(row_number() OVER (PARTITION BY source_file, page_number ORDER BY reading_order) - 1 AS INT) AS place, label, reading_order, CASE WHEN label = 'fig' THEN '![Figure](' || name || ')' ELSE text END AS text,
    CASE WHEN label = 'fig' THEN name END AS figure_path FROM n"""


def all_elements(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.all_elements(assembly.documents(_elements(spark, sf))).select("source_file", "page_number", "label", "reading_order", "text", F.col("bbox")[0].alias("x1"))


def document_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as Markdown, a separator between pages, and their titles."""
    docs = assembly.documents(assembly.figure_link(_elements(spark, sf)))
    texts = assembly.markdown(docs)
    titles = docs.select("source_file", assembly.title(F.struct("source_file", "pages")).alias("title"))
    return texts.join(titles, "source_file").select("source_file", "title", F.length("markdown").alias("length"), F.md5("markdown").alias("digest"))


DOCUMENT_MARKDOWN_SQL = f"""WITH {ELEMENTS_SQL}, m AS (SELECT *, CASE label WHEN 'sec_0' THEN '# ' || text || chr(10) || chr(10) WHEN 'list' THEN '- ' || text || chr(10)
    WHEN 'fig' THEN printf('![Figure](figures/figure_%03d_%03d.png)', page_number, reading_order) || chr(10) || chr(10) ELSE text || chr(10) || chr(10) END AS md FROM e),
p AS (SELECT source_file, page_number, string_agg(md, '' ORDER BY reading_order) AS md, arg_min(text, reading_order) FILTER (label = 'sec_0') AS head FROM m GROUP BY ALL),
d AS (SELECT source_file, string_agg(md, '---' || chr(10) || chr(10) ORDER BY page_number) AS md, arg_min({{'h': head}}, page_number).h AS head FROM p GROUP BY source_file)
SELECT source_file, coalesce(head, replace(replace(source_file, 'in/', ''), '.pdf', '')) AS title, length(md) AS length, md5(md) AS digest FROM d"""


def element_failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = _elements(spark, sf).withColumn("error", F.when(F.col("reading_order") % 11 == 0, F.concat(F.lit("ValueError: "), "text")))
    return assembly.failures(rows, "source_file", "w1")


# Page layouts: four elements for each customer, in a page of 700 x 1000 pixels; every second page's boxes overlap.
LAYOUT = """concat('[', c_custkey % 300, ',', c_custkey % 700, ',', c_custkey % 300 + 250, ',', c_custkey % 700 + 90, '][para][PAIR_SEP][',
    c_custkey % 300 + 10, '.5,', c_custkey % 700 + 40 + 60 * (c_custkey % 2), ',', c_custkey % 300 + 200, ',', c_custkey % 700 + 130, '][sec_0][RELATION_SEP][', c_custkey % 880, ',10,', c_custkey % 880, ',10][fig][PAIR_SEP] [800,850,896,896][tab]')"""
_DIMS = "named_struct('original_width', 700, 'original_height', 1000, 'padded_width', 1000, 'padded_height', 1000)"
LAYOUT_SQL = """c AS (SELECT c_custkey AS page, c_custkey % 300 AS a, c_custkey % 700 AS b, c_custkey % 880 AS f, c_custkey % 2 AS odd FROM customer),
l AS (SELECT page, 0 AS ro, 'para' AS label, [a, b, a + 250, b + 90]::DOUBLE[] AS v FROM c UNION ALL SELECT page, 1, 'sec_0', [a + 10.5, b + 40 + 60 * odd, a + 200, b + 130]::DOUBLE[] FROM c
      UNION ALL SELECT page, 2, 'fig', [f, 10, f, 10]::DOUBLE[] FROM c UNION ALL SELECT page, 3, 'tab', [800, 850, 896, 896]::DOUBLE[] FROM c),
x AS (SELECT page, ro, label, greatest(0, least(round_even(v[1] / 896 * 1000, 0)::INT, 999)) AS x1, greatest(0, least(round_even(v[2] / 896 * 1000, 0)::INT, 999)) AS y1,
      greatest(0, least(round_even(v[3] / 896 * 1000, 0)::INT + 1, 1000)) AS x2, greatest(0, least(round_even(v[4] / 896 * 1000, 0)::INT + 1, 1000)) AS y2 FROM l),
k AS (SELECT page, ro, label, x1, y1, CASE WHEN x2 <= x1 THEN least(x1 + 1, 1000) ELSE x2 END AS x2, CASE WHEN y2 <= y1 THEN least(y1 + 1, 1000) ELSE y2 END AS y2 FROM x),
r AS (SELECT page, ro, label, x1, y1, x2, y2 FROM k WHERE ro = 0
      UNION ALL SELECT page, ro, label, x1, t, x2, CASE WHEN over AND y2 <= t THEN least(t + 1, 1000) ELSE y2 END FROM (
        SELECT k.page, k.ro, k.label, k.x1, k.x2, k.y2, k.x1 < r.x2 AND k.x2 > r.x1 AND k.y1 < r.y2 AND k.y2 > r.y1 AS over,
               CASE WHEN k.x1 < r.x2 AND k.x2 > r.x1 AND k.y1 < r.y2 AND k.y2 > r.y1 THEN least(r.y2, 999) ELSE k.y1 END AS t FROM r JOIN k ON k.page = r.page AND k.ro = r.ro + 1)),
o AS (SELECT *, greatest(0, x1 - 150) AS ox1, least(700, x2 - 150) AS ox2, y1 AS oy1, least(1000, y2) AS oy2 FROM r)"""


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "customer").selectExpr("c_custkey AS page", f"{LAYOUT} AS layout", f"{_DIMS} AS dims")
    return assembly.layout_elements(pages)


def layout_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes in the padded page, pushed below the box before where they overlap it, and in the page itself."""
    return _boxes(spark, sf).select("page", "label", "reading_order", *[F.col(f"{b}.{x}").alias(f"{b}_{x}") for b in ("box", "original") for x in ("x1", "y1", "x2", "y2")])


def box_sizes(spark: SparkSession, sf: str) -> DataFrame:
    size = layout.box_size("original")
    return _boxes(spark, sf).select("page", "reading_order", *[size[k].alias(k) for k in ("width", "height", "area")])


def original_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of a padded page in the page itself, with padding on the left or above, by customer."""
    dims = F.struct(*[F.expr(e).alias(n) for n, e in (("original_width", "CAST(400 + c_custkey % 3 * 150 AS INT)"), ("original_height", "CAST(550 AS INT)"), ("padded_width", "CAST(700 AS INT)"), ("padded_height", "CAST(700 AS INT)"))])
    box = {k: F.expr(f"CAST({e} AS INT)") for k, e in (("x1", "c_custkey % 690"), ("y1", "c_custkey % 600"), ("x2", "c_custkey % 690 + 5"), ("y2", "c_custkey % 600 + 99"))}
    got = layout.to_original(box, dims)
    return table(spark, sf, "customer").select("c_custkey", *[v.alias(k) for k, v in got.items()])


ORIGINAL_SQL = """WITH c AS (SELECT c_custkey, 400 + c_custkey % 3 * 150 AS w, 550 AS h, (700 - (400 + c_custkey % 3 * 150)) // 2 AS l, 75 AS t, c_custkey % 690 AS x, c_custkey % 600 AS y FROM customer),
b AS (SELECT *, greatest(0, x - l) AS x1, greatest(0, y - t) AS y1, least(w, x + 5 - l) AS x2, least(h, y + 99 - t) AS y2 FROM c)
SELECT c_custkey, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(CASE WHEN x2 <= x1 THEN least(x1 + 1, w) ELSE x2 END AS INT) AS x2, CAST(CASE WHEN y2 <= y1 THEN least(y1 + 1, h) ELSE y2 END AS INT) AS y2 FROM b"""


def job_status(spark: SparkSession, sf: str) -> DataFrame:
    """Where a run stands at a fixed time, with events as uploads."""
    now = F.lit("2024-01-20 12:30:00").cast("timestamp")
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("modificationTime")).where(F.col("modificationTime") <= now)
    found = operations.status(1000, 310, operations.hourly(e, now), e, now)
    return found.select("total", "processed", "percent", "remaining", "age", "active", F.round("items_per_hour", 6).alias("items_per_hour"), F.round("hours_left", 6).alias("hours_left"))


STATUS_SQL = """WITH e AS (SELECT ts FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:30:00'), h AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM e WHERE ts > TIMESTAMP '2024-01-19 12:30:00' GROUP BY 1 ORDER BY 1 DESC LIMIT 3),
r AS (SELECT avg(n) / 35.0::DOUBLE AS rate FROM h), l AS (SELECT CAST(epoch(TIMESTAMP '2024-01-20 12:30:00') - floor(epoch(max(ts))) AS BIGINT) AS s FROM e)
SELECT 1000 AS total, 310 AS processed, 31::BIGINT AS percent, 690 AS remaining, CASE WHEN s < 60 THEN printf('%d seconds', s) WHEN s < 3600 THEN printf('%d minutes', s // 60) WHEN s < 86400 THEN printf('%d hours %d minutes', s // 3600, s // 60 % 60) ELSE printf('%d days %d hours', s // 86400, s // 3600 % 24) END AS age,
    s <= 3600 AS active, round(rate, 6) AS items_per_hour, round(690 / rate, 6) AS hours_left FROM r, l"""


def _hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every third chunk of a document as a hit of one of ten questions, and all chunks."""
    found = chunking.hybrid_chunks(fixtures.markdown(spark, sf), chunks.HYBRID)
    hits = found.where("chunk_type = 'coarse' AND chunk_index % 3 = 1")
    return hits.select((F.col("paper_id").cast("long") % 10).alias("query_id"), (F.col("paper_id").cast("long") * 1000 + F.col("chunk_index")).alias("rank"), F.lit(1.0).alias("score"), "chunk_id", "paper_id", "chunk_type", "chunk_index"), found


def hit_context(spark: SparkSession, sf: str) -> DataFrame:
    hits, found = _hits(spark, sf)
    return retrieval.with_context(hits, found, 1).select("chunk_id", F.size("context").alias("chunks"), F.md5(F.array_join("context", "|")).alias("digest"))


def hit_details(spark: SparkSession, sf: str) -> DataFrame:
    """Fine chunks of the coarse chunks that were hit."""
    hits, found = _hits(spark, sf)
    return retrieval.fine_of_coarse(hits, found.where("chunk_type = 'fine'").drop("score")).select("chunk_id", "parent_chunk_id", "query_id", F.md5("text").alias("digest"))


CONTEXT_SQL = f"""WITH {chunks.COARSE_SQL} SELECT paper_id || '_coarse_' || printf('%04d', h.chunk_index) AS chunk_id, CAST(count(*) AS INT) AS chunks, md5(string_agg(c.text, '|' ORDER BY c.chunk_index)) AS digest
FROM coarse h JOIN coarse c USING (paper_id) WHERE h.chunk_index % 3 = 1 AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY paper_id, h.chunk_index"""
DETAILS_SQL = f"""WITH {chunks.FINE_SQL} SELECT paper_id || '_fine_' || printf('%04d', chunk_index) AS chunk_id, paper_id || '_coarse_' || printf('%04d', parent) AS parent_chunk_id, CAST(paper_id AS BIGINT) % 10 AS query_id, md5(text) AS digest FROM fine WHERE parent % 3 = 1"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as requests: blank questions and unknown models go, the default model where none is named."""
    named = F.when(F.col("turn") % 3 == 0, F.lit(retrieval.MODELS[2][0])).when(F.col("turn") % 3 == 1, F.lit("unknown"))
    asked = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, F.lit(" \t")).otherwise(F.col("text")).alias("query"), named.alias("model"))
    return retrieval.valid_requests(asked, retrieval.models(spark)).select("conv_id", "turn", "model")


def abstracts(spark: SparkSession, sf: str) -> DataFrame:
    """Abstracts from inverted indexes: a word's places, in words."""
    index = "map('b', array(1, 3), concat('w', o_orderkey), array(0), 'end', array(CAST(2 + 2 * (o_orderkey % 2) AS INT)))"
    w = table(spark, sf, "orders").selectExpr(f"named_struct('id', concat('W', o_orderkey), 'abstract_inverted_index', {index}) AS work")
    return works.abstracts(w)


def durations(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_orderkey").cast("int") % 50)
    return table(spark, sf, "orders").select("o_orderkey", operations.duration_seconds("o_orderdate", ends).alias("seconds"))


def languages_negotiated(spark: SparkSession, sf: str) -> DataFrame:
    """The language of a request's header, by a header for each of four languages."""
    d = table(spark, sf, "documents")
    header = F.concat(F.col("lang"), F.lit("-XX,en;q=0."), F.col("doc_id") % 10, F.lit(" , fr ; q=0.5"))
    return d.select("doc_id", names.negotiated_language(header).alias("language"))


NEGOTIATED_SQL = "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang WHEN doc_id % 10 >= 5 THEN 'en' ELSE 'fr' END AS language FROM documents"


def known_values(spark: SparkSession, sf: str) -> DataFrame:
    kept = names.known_values(F.create_map(F.lit("a"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")), F.lit("b"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("known"))


def dashboard_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.dashboard(chunks._metrics(spark, sf).withColumn("coherence", F.when(F.col("count") % 2 == 0, F.col("coherence"))), "source")
    return found.withColumn("value", F.round("value", 6))


DASHBOARD_SQL = "WITH {0}, c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT m.*, CASE WHEN c.n % 2 = 0 THEN coherence ELSE 0 END AS shown FROM m JOIN c USING (source)) {1}".format(
    chunks.METRICS_SQL, " UNION ALL ".join(f"SELECT source, '{title}' AS panel, round({'shown' if c == 'coherence' else c}, 6) AS value FROM b" for c, title in reports.PANELS)
)


def radar_rows(spark: SparkSession, sf: str) -> DataFrame:
    return reports.radar(chunks._metrics(spark, sf), "source").withColumn("value", F.round("value", 6))


RADAR_SQL = f"WITH {chunks.METRICS_SQL} " + " UNION ALL ".join(
    f"SELECT source, '{c}' AS axis, round(CASE WHEN min({c}) OVER () = max({c}) OVER () THEN 0.5 ELSE {'1 - ' if low else ''}({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 6) AS value FROM m" for c, low in evaluation.COMPARED.items()
)


def strategy_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons by source; metrics that no rounding is at stake with."""
    m = table(spark, sf, "documents").groupBy("source").agg((F.count("*") % 7 / 8).alias("coherence"), F.lit(None).cast("double").alias("boundary"), (F.count("*") % 5 / 4).alias("citation_coverage"), F.max("n_chars").cast("double").alias("std_chars"))
    return reports.reasons(m, "source").select("source", F.array_join("reasons", "|").alias("reasons"))


REASONS_SQL = """SELECT source, printf('Semantic coherence %.3f', (count(*) % 7) / 8.0::DOUBLE) || '|' || printf('Citations in %.1f', (count(*) % 5) / 4.0::DOUBLE * 100) || '% of the chunks|' || printf('Chunk sizes with a deviation of %.0f characters', max(n_chars)::DOUBLE) AS reasons FROM documents GROUP BY source"""


def chunk_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.total_chunks(evaluation.chunk_statistics(table(spark, sf, "documents"), ["source"]))


def works_report(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of works as lines of text."""
    return works.summary_report(works.flatten(fixtures.works(spark, sf), full_json=False)).select(F.col("place").cast("int"), "line")


def _thousands(value: str) -> str:
    return f"format('{{:,}}', CAST({value} AS BIGINT))"


def _report_sql() -> str:
    n, share = "(SELECT count(*) FROM f)", lambda c: f"' (' || printf('%.1f', {c} * 100.0::DOUBLE / (SELECT count(*) FROM f)) || '%)'"
    counts = [("Works with PDF URLs", "count(*) FILTER (has_any_pdf)"), ("Works without PDF URLs", "count(*) FILTER (NOT has_any_pdf)"), ("Works with best open PDF", "count(best_oa_pdf_url)"), ("Works with primary PDF", "count(primary_pdf_url)"), ("Works with DOI", "count(doi)"), ("Works without DOI", "(count(*) - count(doi))")]
    lines = [("Works", _thousands(n)), *[(t, f"(SELECT {_thousands(c)} || {share(c)} FROM f)") for t, c in counts], ("Years", "(SELECT min(publication_year) || ' to ' || max(publication_year) FROM f)")]
    lines += [("Citations in all", f"(SELECT {_thousands('sum(cited_by_count)')} FROM f)"), ("Citations, mean", "(SELECT printf('%.2f', avg(cited_by_count)) FROM f)"), ("Citations, median", "(SELECT printf('%.0f', median(cited_by_count)) FROM f)"), ("Citations, most", f"(SELECT {_thousands('max(cited_by_count)')} FROM f)")]
    fixed = " UNION ALL ".join(f"SELECT {i} AS place, '{t}: ' || {v} AS line" for i, (t, v) in enumerate(lines))
    status = f"SELECT CAST(99 + row_number() OVER (ORDER BY count(*) DESC, oa_status) AS INT) + 0 AS place, 'Open access, ' || oa_status || ': ' || {_thousands('count(*)')} || {share('count(*)')} AS line FROM f GROUP BY oa_status"
    source = f"SELECT CAST(199 + row_number() OVER (ORDER BY c DESC, s) AS INT) AS place, 'Source, ' || s || ': ' || {_thousands('c')} AS line FROM (SELECT best_oa_source AS s, count(*) AS c FROM f WHERE best_oa_source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"
    return f"WITH {records.WORKS_SQL} SELECT CAST(place AS INT) AS place, line FROM ({fixed} UNION ALL {status} UNION ALL {source})"


def works_filtered(spark: SparkSession, sf: str) -> DataFrame:
    flat = works.flatten(fixtures.works(spark, sf), full_json=False)
    return works.filtered(flat, lambda f: (f["publication_year"] >= 1995) & f["is_oa"]).select("openalex_id", "publication_year")


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    found = incremental.windowed_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    found = incremental.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "events")


SESSIONS_SQL = """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
n AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS "end", count(*) AS events FROM n GROUP BY user_id, session"""


def object_states(spark: SparkSession, sf: str) -> DataFrame:
    """A user's day as an object: purchases say it is done, errors that it failed. A stream over the events, its state restarted for each part of them."""
    outcome = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'listed' END AS outcome"
    events = table(spark, sf, "events").selectExpr("concat(user_id, '/', date_format(ts, 'yyyy-MM-dd')) AS object", outcome, "CAST(ts AS TIMESTAMP) AS time", "CAST(event_id % 2 AS INT) AS half")
    source, changes, checkpoint = (scratch_path(spark, f"states-{n}") for n in ("events", "changes", "checkpoint"))
    for half in (0, 1):
        events.where(f"half = {half}").drop("half").write.mode("append").parquet(source)
        stream = incremental.stream_table(spark, source, "object string, outcome string, time timestamp")
        objects.write_changes(stream, changes, checkpoint, retries=1, stale=datetime.timedelta(days=10_000), late="9000 days").awaitTermination()
    return objects.current(spark.read.parquet(changes)).select("object", "status", "failures", F.unix_millis("last").alias("last_ms"))


OBJECT_STATES_SQL = """WITH g AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS object, count(*) FILTER (event_type = 'purchase') AS done, CAST(count(DISTINCT epoch_us(ts) // 1000) FILTER (event_type = 'error') AS INT) AS failures, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY 1)
SELECT object, CASE WHEN done > 0 THEN 'done' WHEN failures > 1 THEN 'failed' WHEN failures > 0 THEN 'retry' ELSE 'waiting' END AS status, failures, last_ms FROM g"""


def first_object(spark: SparkSession, sf: str) -> DataFrame:
    listing = table(spark, sf, "pages").select(F.concat(F.lit("raw/"), F.lpad((F.col("page_id") * 7919 % 1000).cast("string"), 4, "0"), F.lit("_W"), "page_id", F.lit(".pdf")).alias("path"))
    return find_object(listing, "05")


def embedding_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents indexed by an embedder that SQL can state, searched with the benchmark's items."""
    docs = fixtures.documents(spark, sf).select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = retrieval.top_k(retrieval.index(docs, fixtures.LetterCounts), retrieval.embed_queries(items, fixtures.LetterCounts), 10)
    return hits.select("query_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


SEARCH_SQL = f"""WITH v AS (SELECT doc_id, list_transform({chunks._unit_sql('text')}, lambda c: c::FLOAT)::DOUBLE[] AS v FROM documents), q AS (SELECT item_id, {chunks._unit_sql('text')} AS q FROM benchmark),
s AS (SELECT item_id AS query_id, list_dot_product(q, v) AS score FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) - 1 AS rank FROM s)
SELECT query_id, round(score, 6) AS score, rank FROM r WHERE rank < 10"""

QUERIES = {
    "document_elements": (document_elements, DOCUMENT_ELEMENTS_SQL),
    "all_elements": (all_elements, f"WITH {ELEMENTS_SQL} SELECT source_file, page_number, label, reading_order, text, x1 FROM e"),
    "document_markdown": (document_markdown, DOCUMENT_MARKDOWN_SQL),
    "element_failures": (element_failures, f"WITH {ELEMENTS_SQL} SELECT 'w1' AS worker_id, source_file AS doc_id, 'ValueError: ' || text AS error FROM e WHERE reading_order % 11 = 0"),
    "layout_boxes": (layout_boxes, f"""WITH RECURSIVE {LAYOUT_SQL} SELECT page, label, CAST(ro AS INT) AS reading_order, x1 AS box_x1, y1 AS box_y1, x2 AS box_x2, y2 AS box_y2, CAST(ox1 AS INT) AS original_x1, CAST(CASE WHEN ox2 <= ox1 THEN least(ox1 + 1, 700) ELSE ox2 END AS INT) AS original_x2, CAST(oy1 AS INT) AS original_y1, CAST(oy2 AS INT) AS original_y2 FROM o"""),
    "box_sizes": (box_sizes, f"""WITH RECURSIVE {LAYOUT_SQL}, z AS (SELECT page, ro, CASE WHEN ox2 <= ox1 THEN least(ox1 + 1, 700) ELSE ox2 END - ox1 AS w, oy2 - oy1 AS h FROM o) SELECT page, CAST(ro AS INT) AS reading_order, CAST(w AS INT) AS width, CAST(h AS INT) AS height, CAST(w * h AS INT) AS area FROM z"""),
    "original_boxes": (original_boxes, ORIGINAL_SQL),
    "job_status": (job_status, STATUS_SQL),
    "hit_context": (hit_context, CONTEXT_SQL),
    "hit_details": (hit_details, DETAILS_SQL),
    "requests": (requests, f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '{retrieval.MODELS[2][0]}' ELSE '{retrieval.DEFAULT_MODEL}' END AS model FROM conversations WHERE turn > 0 AND turn % 3 <> 1"),
    "abstracts": (abstracts, "SELECT 'W' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'w' || o_orderkey || ' b end b' ELSE 'w' || o_orderkey || ' b b end' END AS abstract FROM orders"),
    "durations": (durations, "SELECT o_orderkey, ((o_orderkey % 50) * 3600)::DOUBLE AS seconds FROM orders"),
    "languages_negotiated": (languages_negotiated, NEGOTIATED_SQL),
    "known_values": (known_values, "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'a=' || n_chars END, CASE WHEN doc_id % 3 = 0 THEN 'b=' || doc_id END) AS known FROM documents"),
    "dashboard_rows": (dashboard_rows, DASHBOARD_SQL),
    "radar_rows": (radar_rows, RADAR_SQL),
    "strategy_reasons": (strategy_reasons, REASONS_SQL),
    "chunk_totals": (chunk_totals, "SELECT count(*) AS total_chunks FROM documents"),
    "works_report": (works_report, _report_sql()),
    "works_filtered": (works_filtered, f"WITH {records.WORKS_SQL} SELECT openalex_id, publication_year FROM f WHERE publication_year >= 1995 AND is_oa"),
    "event_windows": (event_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL"),
    "event_sessions": (event_sessions, SESSIONS_SQL),
    "object_states": (object_states, OBJECT_STATES_SQL),
    "first_object": (first_object, "SELECT path FROM (SELECT 'raw/' || lpad((page_id * 7919 % 1000)::VARCHAR, 4, '0') || '_W' || page_id || '.pdf' AS path FROM pages) WHERE path LIKE 'raw/05%' ORDER BY path LIMIT 1"),
    "embedding_search": (embedding_search, SEARCH_SQL),
}
